"""The unified filter: a nested dict of conditions becomes one Column predicate, applied before any top-k."""

from __future__ import annotations

import warnings
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.text import contains_text, like_glob

#: The sections a filter may have.
SECTIONS = ("doc_ids", "source", "metadata", "pairs", "content", "dates", "processing")


def validate(spec: Any) -> dict[str, Any]:
    """Known sections of a filter; others raise a warning, anything but a dict an error."""
    if not isinstance(spec, dict):
        raise TypeError(f"a filter is a dict, not {type(spec).__name__}")
    for key in sorted(set(spec) - set(SECTIONS)):
        warnings.warn(f"filter section {key!r} is not known and left out", stacklevel=2)
    return {k: v for k, v in spec.items() if k in SECTIONS}


def _between(c: Column, low: Any, high: Any) -> list[Column]:
    return ([c >= low] if low is not None else []) + ([c <= high] if high is not None else [])


def _json(field: str) -> Column:
    return F.get_json_object("metadata", f"$.{field}")


def as_time(value: Any) -> Column:
    """Epoch seconds or ISO text as epoch seconds."""
    return F.lit(float(value)) if isinstance(value, int | float) else F.unix_timestamp(F.to_timestamp(F.lit(value))).cast("double")


def conditions(spec: dict[str, Any]) -> list[Column]:
    """The single predicates of a filter over registry columns; all must hold."""
    spec, out = validate(spec), []
    if spec.get("doc_ids"):
        out.append(F.col("doc_id").isin(list(spec["doc_ids"])))
    source = spec.get("source", {})
    if "contains" in source:
        out.append(contains_text(F.col("source"), source["contains"]))
    if "not_contains" in source:
        out.append(~contains_text(F.col("source"), source["not_contains"]))
    if "pattern" in source:
        out.append(like_glob(F.col("source"), source["pattern"]))
    meta = spec.get("metadata", {})
    out += [_json(k) == meta[k] for k in ("source_type", "parse_method") if k in meta]
    size = meta.get("file_size", {})
    out += _between(_json("file_size").cast("double"), size.get("min"), size.get("max"))
    pairs = spec.get("pairs", {})
    out += [contains_text(F.to_json("pairs"), pairs[k]) for k in ("contains", "model_contains", "part_contains") if k in pairs]
    content = spec.get("content", {})
    if "keywords_contain" in content:
        out.append(contains_text(F.col("keywords"), content["keywords_contain"]))
    if "text_contains" in content:
        out.append(contains_text(F.col("text"), content["text_contains"]))
    dates = spec.get("dates", {})
    for key, column, after in (("created_after", "created_at", True), ("created_before", "created_at", False), ("modified_after", "modified_time", True)):
        if key in dates:
            out.append(F.col(column) >= as_time(dates[key]) if after else F.col(column) <= as_time(dates[key]))
    state = spec.get("processing", {})
    if "indexed" in state:
        both = F.col("vector_indexed") & F.col("keyword_indexed")
        out.append(both if state["indexed"] else ~both)
    count = state.get("chunk_count", {})
    out += _between(F.col("chunk_count"), count.get("min"), count.get("max"))
    if "has_keywords" in state:
        some = F.coalesce("keywords", F.lit("")) != ""
        out.append(some if state["has_keywords"] else ~some)
    return out


def predicate(spec: dict[str, Any]) -> Column:
    out = F.lit(True)
    for c in conditions(spec):
        out &= c
    return out


def pair_predicate(model: str | None = None, part: str | None = None) -> Column:
    """Case-sensitive: any pair whose model, and any whose part, contains the text."""
    out = F.lit(True)
    if model is not None:
        out &= F.exists("pairs", lambda p: F.contains(p["model"], F.lit(model)))
    if part is not None:
        out &= F.exists("pairs", lambda p: F.contains(p["part"], F.lit(part)))
    return out


def metadata_predicate(wanted: dict[str, str], column: str = "metadata") -> Column:
    """Every key of a JSON column equals its text; a missing key counts as empty."""
    out = F.lit(True)
    for k, v in wanted.items():
        out &= F.coalesce(F.get_json_object(column, f"$.{k}"), F.lit("")) == v
    return out


def input_problem(source: Column, size: Column, extensions: tuple[str, ...] = (".pdf", ".txt", ".md"), most: int = 100 << 20, longest_url: int = 2048) -> Column:
    """Why an input is refused, or null: url_too_long, bad_extension, file_too_large."""
    url = source.startswith("http://") | source.startswith("https://")
    known = F.lit(False)
    for e in extensions:
        known |= F.lower(source).endswith(e)
    return F.when(url, F.when(F.length(source) > longest_url, "url_too_long")).otherwise(F.when(~known, "bad_extension").when(size > most, "file_too_large"))


def vector_spec(filters: dict[str, Any]) -> dict[str, Any]:
    """The part of a filter that a vector table answers by itself, as {column: value, {"$in": [...]} or {"$contains": text}}."""
    out: dict[str, Any] = {}
    if filters.get("doc_ids"):
        out["doc_id"] = {"$in": list(filters["doc_ids"])}
    if isinstance(filters.get("source"), dict) and "contains" in filters["source"]:
        out["source"] = {"$contains": filters["source"]["contains"]}
    for name in ("source_type", "parse_method"):
        if isinstance(filters.get("metadata"), dict) and name in filters["metadata"]:
            out[name] = filters["metadata"][name]
    return out


def spec_predicate(spec: dict[str, Any]) -> Column:
    """A vector table's filter as a condition that holds before any cut; an empty one is true."""
    found = F.lit(True)
    for name, value in spec.items():
        c = F.col(name)
        if isinstance(value, dict) and "$in" in value:
            found &= c.isin(list(value["$in"]))
        elif isinstance(value, dict) and "$contains" in value:
            found &= F.contains(c, F.lit(value["$contains"]))
        else:
            found &= c == value
    return found


def _any_holds(values: Column, text: str) -> Column:
    return F.exists(values, lambda v: F.contains(v, F.lit(text)))


def after_vectors(filters: dict[str, Any]) -> Column:
    """What a vector table can't answer, on hits with pairs, file_size, text and keywords (an array): letters count by case,
    one pair's model and any pair's part may match, a size that is missing or 0 is not judged."""
    part = lambda name: filters[name] if isinstance(filters.get(name), dict) else {}
    found, pairs, size, content = F.lit(True), part("pairs"), part("metadata").get("file_size"), part("content")
    for key, field in (("model_contains", "model"), ("part_contains", "part")):
        if key in pairs:
            found &= F.coalesce(_any_holds(F.col(f"pairs.{field}"), pairs[key]), F.lit(False))
    if isinstance(size, dict):
        known = F.coalesce(F.col("file_size"), F.lit(0)) != 0
        for key, bad in (("min", F.col("file_size") < size.get("min", 0)), ("max", F.col("file_size") > size.get("max", 0))):
            if key in size:
                found &= ~(known & bad)
    if "text_contains" in content:
        found &= F.contains(F.coalesce("text", F.lit("")), F.lit(content["text_contains"]))
    if "keywords_contain" in content:
        found &= F.contains(F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " "), F.lit(content["keywords_contain"]))
    return found
