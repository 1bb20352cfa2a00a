"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of keyword indexes, and the least length of a token is 3.
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for")
TOKEN = r"[\p{L}\p{N}_]+"


def tokenize(text: Column) -> Column:
    """Lower-case word tokens longer than two characters that are no stop words; null text has none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(words, lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS))


def clean_text(text: Column) -> Column:
    """Markdown characters become spaces, runs of white space one space, ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[#*`\[\]()]", " "), r"\s+", " "))


def word_set(text: Column) -> Column:
    """Distinct lower-case words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct items; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def fixed_chunks(text: Column, width: int) -> Column:
    """Array of consecutive pieces of ``width`` characters."""
    n = F.ceil(F.length(text) / F.lit(width)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * width + 1, F.lit(width)))
    return F.when(F.length(text) > 0, pieces).otherwise(F.array().cast("array<string>"))


def contains_text(c: Column, needle: str) -> Column:
    """Whether a needle occurs, A-Z and a-z alike; wildcard characters in it stand for themselves."""
    return F.contains(F.lower(c), F.lower(F.lit(needle)))


def like_glob(c: Column, pattern: str) -> Column:
    """Whole match with ``*`` for any run and ``?`` for one character, letters of either case alike."""
    escaped = pattern.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_").replace("*", "%").replace("?", "_")
    return F.lower(c).like(escaped.lower())


def context_keywords(text: Column) -> Column:
    """The first line with anything in it behind a ``Context:`` or ``Keywords:`` marker, trimmed; empty without one."""
    return F.rtrim(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?:Context|Keywords):\s*([^\n]*)", 1))


def keyword_list(answer: Column) -> Column:
    """A model's JSON list: code fences go, single quotes become double, blank items are dropped; else an empty list."""
    bare = F.translate(F.regexp_replace(F.trim(answer), r"^```(?:json)?\n|\n```$", ""), "'", '"')
    items = F.from_json(bare, "array<string>")
    return F.coalesce(F.filter(F.transform(items, lambda k: F.trim(k)), lambda k: k.isNotNull() & (k != "")), F.array().cast("array<string>"))


def one_decimal(x: Column) -> Column:
    """One decimal as Python's and C's printf give it: the exact value of the double is rounded, true ties to even.

    Java's rounds the shortest digits half up instead.  8x and 2x are exact, and so is the error of their sum.
    """
    ten = x * 8.0 + x * 2.0
    error = x * 2.0 - (ten - x * 8.0)
    low = F.floor(ten).cast("double")
    tenths = F.when(ten - low != 0.5, F.rint(ten)).when(error > 0, low + 1).when(error < 0, low).otherwise(F.rint(ten))
    return F.format_string("%.1f", tenths / 10.0)


def format_duration(seconds: Column) -> Column:
    """Seconds, minutes or hours with one decimal."""
    one = one_decimal
    return F.when(seconds < 60, F.concat(one(seconds), F.lit("s"))).when(seconds < 3600, F.concat(one(seconds / 60), F.lit("m"))).otherwise(F.concat(one(seconds / 3600), F.lit("h")))


def format_file_size(size: Column) -> Column:
    """Bytes with the largest unit up to TB that leaves at least 1, one decimal."""
    size = size.cast("double")
    out = F.concat(one_decimal(size / 1024.0**4), F.lit("TB"))
    for power, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(size < 1024.0 ** (power + 1), F.concat(one_decimal(size / 1024.0**power), F.lit(unit))).otherwise(out)
    return out


def metadata_pairs(text: Column) -> Column:
    """Map from ``k=v,k2=v2``."""
    return F.str_to_map(text, F.lit(","), F.lit("="))


def typed_metadata(items: Column) -> Column:
    """Map from ``k=v`` items: key to the value's kind (string, number, boolean, null, array, object) and its text; a value that
    is JSON is of its kind, any other a string, blanks around keys and values don't count and the last of equal keys does.

    Items without ``=`` or without a key are an error, as whoever wrote them should know.
    """
    cut = F.transform(items, lambda i: F.struct(F.trim(F.substring_index(i, "=", 1)).alias("k"), F.when(F.contains(i, F.lit("=")), F.trim(F.substr(i, F.instr(i, "=") + 1))).alias("v")))
    checked = F.transform(cut, lambda p: F.when(p["v"].isNotNull() & (p["k"] != ""), p).otherwise(F.raise_error(F.lit("metadata must be key=value"))))

    def value(v: Column) -> Column:
        read = F.try_parse_json(v)
        kind = F.schema_of_variant(read)
        name = F.when(read.isNull(), "string").when(F.is_variant_null(read), "null").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("number")
        text = F.when(name.isin("array", "object"), F.to_json(read)).when(name == "string", F.coalesce(F.try_variant_get(read, "$", "string"), v)).otherwise(v)
        return F.struct(name.alias("kind"), text.alias("value"))

    pairs = F.transform(checked, lambda p: F.struct(p["k"], value(p["v"])))
    keys = F.transform(checked, lambda p: p["k"])
    return F.map_from_entries(F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["k"])))
