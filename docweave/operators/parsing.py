"""Classification, extraction and chunking of documents."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of file names that tell datasheets from other documents; the first ones also count for confidence.
DATASHEET = ("datasheet", "ds.pdf", "spec", "specification", "product_brief", "technical_data", "sensor", "laser", "manual", "model", "part_number")
GENERIC = ("report", "paper", "article", "research", "white_paper", "guide", "tutorial", "documentation", "readme")
SURE_DATASHEET, SURE_GENERIC = DATASHEET[:8], GENERIC[:5]
#: What a query about a part or a model looks like.
PART_NUMBER = r"\d{7}|\d{2}-\d{3}-\d{3}"
MODEL_WORDS = ("matrix", "model", "laser", "series")


def file_name(source: Column) -> Column:
    return F.lower(F.substring_index(source, "/", -1))


def _any(name: Column, parts: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(name, p))


def classify(source: Column, datasheet_mode: bool = True) -> Column:
    """markdown (plain text too), datasheet_pdf, generic_pdf, or unsupported; the mode decides where names do not."""
    name = file_name(source)
    d, g = _any(name, DATASHEET), _any(name, GENERIC)
    pdf = F.when(d & ~g, "datasheet_pdf").when(g & ~d, "generic_pdf").otherwise("datasheet_pdf" if datasheet_mode else "generic_pdf")
    return F.when(name.rlike(r"\.(md|markdown|txt)$"), "markdown").when(name.endswith(".pdf"), pdf).otherwise("unsupported")


def confidence(source: Column, kind: Column) -> Column:
    """1 for Markdown, 0.5 to 0.9 by the number of telling parts of a PDF's name, else 0.5."""
    found = lambda parts: F.size(F.filter(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(file_name(source), p)))
    of = lambda parts: F.least(F.lit(0.9), 0.5 + found(parts) * 0.2)
    return F.when(kind == "markdown", 1.0).when(kind == "datasheet_pdf", of(SURE_DATASHEET)).when(kind == "generic_pdf", of(SURE_GENERIC)).otherwise(0.5)


def parse_timeout(pages: Column, base: int = 60, per_page: int = 30) -> Column:
    return base + pages * per_page


def analyse_query(query: Column) -> list[Column]:
    """has_part_number, has_model_reference, detected_part_numbers, query_type."""
    part, model = query.rlike(PART_NUMBER), _any(F.lower(query), MODEL_WORDS)
    return [part.alias("has_part_number"), model.alias("has_model_reference"), F.regexp_extract_all(query, F.lit(PART_NUMBER), F.lit(0)).alias("detected_part_numbers"), F.when(part, "part_number").when(model, "model").otherwise("general").alias("query_type")]


def pairs_from_json(text: Column) -> Column:
    """Pairs of the JSON block before the first separator line; single quotes count as double ones; none else."""
    head = F.when(text.startswith("Metadata:") & F.contains(text, F.lit("\n---\n")), F.substring_index(text, "\n---\n", 1))
    meta = F.from_json(F.translate(F.trim(F.replace(head, F.lit("Metadata:"), F.lit(""))), "'", '"'), "pairs array<array<string>>")
    pairs = F.transform(meta["pairs"], lambda p: F.struct(F.get(p, F.lit(0)).alias("model"), F.get(p, F.lit(1)).alias("part")))
    return F.coalesce(pairs, F.array().cast("array<struct<model:string,part:string>>"))


def closing_brace(text: str, start: int) -> int:
    """Where the brace at ``start`` is closed, quoted parts skipped; -1 if it never is."""
    depth, quote, at = 0, "", start
    while at < len(text):
        c = text[at]
        if quote:
            at += c == "\\"
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return at
        at += 1
    return -1


_MARKER = re.compile(r"metadata:\s*", re.IGNORECASE)


def literal_pairs(text: str | None) -> tuple[list[tuple[str, str]], str | None]:
    """Pairs of the first ``Metadata:`` line whose braces hold a literal with pairs of two texts, and the text without it.

    A code fence around the block goes with it.  Without such a block, or if it is all there is, the text stays as it was.
    """
    for marker in _MARKER.finditer(text or ""):
        at, start = marker.start(), marker.end()
        line = text.rfind("\n", 0, at) + 1
        end = closing_brace(text, start) if text[start : start + 1] == "{" and not text[line:at].strip() else -1
        stop = text.find("\n", end) if text.find("\n", end) >= 0 else len(text)
        if end < 0 or text[end + 1 : stop].strip():
            continue
        try:
            found = ast.literal_eval(text[start : end + 1])["pairs"]
        except (ValueError, SyntaxError, TypeError, KeyError, MemoryError, RecursionError):
            continue
        if isinstance(found, list) and all(isinstance(p, (tuple, list)) and len(p) == 2 and all(isinstance(x, str) for x in p) for p in found):
            before, after = text[:line].rstrip(), text[stop:].lstrip()
            if re.search(r"```\w*$", before) and after.startswith("```"):
                before, after = re.sub(r"```\w*$", "", before).rstrip(), after[3:].lstrip()
            rest = "\n".join(x for x in (before, after) if x).strip()
            return [tuple(p) for p in found], rest or text
    return [], text


_PAIR = T.StructType([T.StructField("model", T.StringType()), T.StructField("part", T.StringType())])
_FOUND = T.StructType([T.StructField("pairs", T.ArrayType(_PAIR)), T.StructField("rest", T.StringType())])


@F.pandas_udf(_FOUND)
def _literal(text: pd.Series) -> pd.DataFrame:
    found = [literal_pairs(t) for t in text]
    return pd.DataFrame({"pairs": [[{"model": m, "part": p} for m, p in x] for x, _ in found], "rest": [r for _, r in found]})


def pairs_from_literal(text: Column) -> tuple[Column, Column]:
    """Columns of ``literal_pairs``: pairs, and the text without their block; only texts with a marker go to Python."""
    marked = text.rlike("(?i)metadata:")
    both = _literal(F.when(marked, text))
    return F.coalesce(both["pairs"], F.array().cast("array<struct<model:string,part:string>>")), F.when(marked, both["rest"]).otherwise(text)


def sentence_windows(text: str, size: int, overlap: int) -> Iterator[str]:
    """Whole sentences packed up to ``size`` words; the next chunk repeats sentences of up to ``overlap`` words."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s.strip()]
    held: list[tuple[str, int]] = []
    total = 0
    for s in sentences:
        n = len(s.split())
        if held and total + n > size:
            yield " ".join(x for x, _ in held)
            back, kept = 0, []
            for x, m in reversed(held):
                if back + m > overlap or back + m + n > size:
                    break
                kept.append((x, m))
                back += m
            held, total = kept[::-1], back
        held.append((s, n))
        total += n
    if held:
        yield " ".join(x for x, _ in held)


def sentence_chunks(docs: DataFrame, size: int = 1024, overlap: int = 128) -> DataFrame:
    """(doc_id, chunk_index, text); packing is sequential within a text, so each text is packed in one piece of Python."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, c) for d, t in zip(b["doc_id"], b["text"]) for i, c in enumerate(sentence_windows(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "text"])

    return docs.select("doc_id", "text").mapInPandas(work, "doc_id bigint, chunk_index bigint, text string")


def heading_sections(text: str) -> Iterator[tuple[str, str]]:
    """(heading, body) of Markdown; lines inside code fences are no headings."""
    heading, lines, fenced = "", [], False
    for line in text.split("\n"):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        m = None if fenced else re.match(r"(#{1,6})\s+(.*)", line)
        if m:
            if heading or any(x.strip() for x in lines):
                yield heading, "\n".join(lines).strip()
            heading, lines = m[2].strip(), []
        else:
            lines.append(line)
    if heading or any(x.strip() for x in lines):
        yield heading, "\n".join(lines).strip()


def markdown_sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section_index, heading, body)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, h, x) for d, t in zip(b["doc_id"], b["text"]) for i, (h, x) in enumerate(heading_sections(t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "section_index", "heading", "body"])

    return docs.select("doc_id", "text").mapInPandas(work, "doc_id bigint, section_index bigint, heading string, body string")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, section_index, body): runs of text between line ends, blank ones left out."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return docs.select("doc_id", F.posexplode(lines).alias("section_index", "body")).withColumn("section_index", F.col("section_index").cast("bigint"))
