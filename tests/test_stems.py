"""Stemmed searches of the stored index against plain Python over whole tables."""

import math
import os
import re
from collections import Counter

import pytest
import regex

from docweave.functions.porter import stem
from docweave.plans import catalog

catalog.load()
SF = "/root/testdata/sf0.001"
WORDS = regex.compile(r"[\p{L}\p{N}_]+")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def chunks(spark):
    """node_id: stems of the text without Markdown characters, and of its line of keywords."""
    out = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for i in range(0, len(r["text"] or ""), 1000):
            piece = r["text"][i : i + 1000]
            plain = re.sub(r"\s+", " ", re.sub(r"[#*`\[\]()]", " ", piece)).strip()
            line = re.search(r"(?:Context|Keywords):\s*([^\n]*)", piece)
            out[f"{r['doc_id']}_{i // 1000}"] = [[stem(w) for w in WORDS.findall(t.lower())] for t in (plain, line[1] if line else "")]
    return out


def gain(n, df, tf, dl, average):
    ratio = (n - df + 0.5) / (df + 0.5)
    return (math.log(ratio) if ratio > 1 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average))


def test_all_words_by_stems_in_all_fields(spark, chunks):
    wanted = [stem("thaneas"), stem("with")]
    counts = {k: Counter(w for field in v for w in field) for k, v in chunks.items()}
    n, average = len(chunks), sum(sum(c.values()) for c in counts.values()) / len(chunks)
    df = {w: sum(w in c for c in counts.values()) for w in wanted}
    scores = {k: -sum(gain(n, df[w], c[w], sum(c.values()), average) for w in wanted) for k, c in counts.items() if all(c[w] for w in wanted)}
    best = sorted(scores.items(), key=lambda x: (round(x[1], 12), x[0]))[:10]
    got = sorted(catalog.QUERIES["keyword_search_porter"](spark, SF).collect(), key=lambda r: r["rank"])
    assert len(got) == min(10, len(scores)) > 0
    assert [r["node_id"] for r in got] == [k for k, _ in best]
    assert [r["score"] for r in got] == pytest.approx([s for _, s in best])


def test_phrases_by_stems(spark, chunks):
    a, b = stem("ofs"), stem("the")
    found = {k: sum(sum(x == a and y == b for x, y in zip(field, field[1:])) for field in v) for k, v in chunks.items()}
    length = {k: sum(map(len, v)) for k, v in chunks.items()}
    n, average, df = len(chunks), sum(length.values()) / len(chunks), sum(v > 0 for v in found.values())
    order = sorted((k for k in found if found[k]), key=lambda k: (-round(gain(n, df, found[k], length[k], average), 12), k))[:15]
    got = sorted(catalog.QUERIES["phrase_search_stemmed"](spark, SF).collect(), key=lambda r: r["rank"])
    assert [(r["node_id"], r["occurrences"]) for r in got] == [(k, found[k]) for k in order]
    assert [r["score"] for r in got] == pytest.approx([1 / (i + 1) for i in range(1, len(order) + 1)])
