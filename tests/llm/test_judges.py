"""Quality rules, language, quality network, URL filter against brute force or held-out accuracy."""

import math
import re
from collections import Counter
from urllib.parse import urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm.langid import LanguageFit, fit_languages, keep_identified, language_predictions, words_of
from docweave.llm.quality_cnn import ByteCnn, CnnFit, quality_scores, train
from docweave.llm.quality_rules import covered, keep_good, repetition_coverage
from docweave.llm.queries import QUERIES
from docweave.llm.url_filter import Propagation, filter_urls, host_verdicts

SF = "/root/testdata/sf0.001"


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at, hit = {}, set()
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in at.values():
        if len(places) > 1:
            hit.update(i + k for i in places for k in range(8))
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_rules_equal_brute_force(odd, docs, none):
    for df in (odd, docs):
        got = sorted((tuple(r[:7]) for r in repetition_coverage(df).collect()), key=str)
        assert got == sorted(((d, *brute_rules(t)) for d, t in df.select("doc_id", "text").collect()), key=str)
    assert repetition_coverage(none).count() == 0


def test_rules_reject_repeats_and_keep_prose(spark):
    prose = " ".join(f"word{i} and{i % 7}" for i in range(60))
    rows = [(1, prose), (2, "again and again we say it " * 20), (3, prose + "\n" + "same line of text here\n" * 40)]
    got = {r["doc_id"]: r["kept"] for r in repetition_coverage(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_coverage_counts_the_first_occurrence():
    assert covered(np.array([1, 2, 3, 9, 1, 2, 3], np.uint64), 3).tolist() == [True, True, True, False, True, True, True]
    assert not covered(np.array([1, 2], np.uint64), 3).any()


def test_kept_documents_have_all_columns(odd):
    kept = keep_good(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} <= {0, 7}


def test_languages(spark, odd, none, docs):
    got = language_predictions(docs).join(docs.select("doc_id", "lang"), "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right[0] > 0.95 and right[1] > 10
    rows = {r["doc_id"]: r for r in language_predictions(odd).collect()}
    assert rows[1]["lang_pred"] == rows[2]["lang_pred"] == rows[3]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert language_predictions(none).count() == 0
    unlearned = language_predictions(spark.createDataFrame([(1, "some words", None)], "doc_id bigint, text string, lang string")).first()
    assert (unlearned["lang_pred"], unlearned["score"]) == ("und", 0.0)


def test_language_ignores_other_columns_and_unseen_words_back_off(docs):
    model = fit_languages(docs, LanguageFit(docs_per_language=200))
    assert model.predict_all(["heiterungschlichkeitüß unverschlichung"])[0][0] == "de"
    kept = keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count()


def test_quality(spark, odd, none, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert {r["predicted"] for r in got} <= {0, 1} and all((r["score"] >= 0.3) == bool(r["predicted"]) for r in got)
    assert quality_scores(none, labels).count() == 0
    rows = quality_scores(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(0 <= r["score"] <= 1 for r in quality_scores(odd, labels.limit(0)).collect())


def test_network_learns_and_covers_whole_texts():
    rng = np.random.default_rng(1)
    plain = [bytes(rng.choice(list(b"abcdefgh "), 600).astype(np.uint8)) for _ in range(160)]
    junk = [p[:550] + b"$$$%%%###" + p[550:] for p in plain[:80]]
    net = train(plain[80:] + junk, np.array([1] * 80 + [0] * 80), 0.5, CnnFit(epochs=12))
    good, bad = net.scores(plain[:60]), net.scores(junk[:60])
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    long = plain[0] * 300  # past the block size: the last bytes still count
    assert net.scores([long])[0] > net.scores([long + b"".join(junk[:20])])[0]


def test_scores_do_not_depend_on_company():
    net, texts = ByteCnn(CnnFit()), [b"", b"a", b"x" * 31, b"y" * 500, b"z" * 200_000]
    assert net.scores(texts) == pytest.approx([net.scores([t])[0] for t in texts], rel=1e-5)


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


def test_url_rules(spark):
    urls = ["http://A.COM", "http://a.com/", "https://x.example.com/en/1?q#f", "https://www.example.com/en/", "ftp://b.net/es/x", "http://net/fr/", "http://anet/fr/", "no url", "", None, "http://a.com?x=http://b.net/es/", "://c.com/é"]
    rows = [(i, u, None) for i, u in enumerate(urls)]
    got = {r["page_id"]: r for r in filter_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute_url(u)
        assert tuple(got[i])[1:] == (host, path, rule, verdict or "allow")
    assert filter_urls(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    assert urlsplit(urls[2]).hostname == got[2]["host"]


def test_distrust_runs_against_links_and_trust_along_them(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    pages = [
        (1, "http://spam.net/es/a", ""), (2, "http://farm.org/", link("spam.net")), (3, "http://good.com/", link("fine.org")),
        (4, "http://fine.org/", ""), (5, "http://mixed.org/", link("spam.net", *[f"h{i}.org" for i in range(30)])), (6, "http://good2.com/", link("mixed.org")),
    ]
    got = {r["page_id"]: r["verdict"] for r in filter_urls(spark.createDataFrame(pages, "page_id bigint, url string, html string"), p=Propagation(threshold=0.02)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow"}


@pytest.mark.parametrize("linkers", [1, 10, 1000])
def test_distrust_does_not_thin_out_among_linkers(spark, linkers):
    """Also where one linker has most of the linking pages."""
    link = '<a href="http://spam.net/">x</a>'
    pages = [(0, "http://spam.net/es/a", ""), *[(i, f"http://farm{i}.org/", link) for i in range(1, linkers + 1)], *[(5000 + i, f"http://big.org/{i}", link) for i in range(200)]]
    got = {r["page_id"]: r["verdict"] for r in filter_urls(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got == {p[0]: "block" for p in pages}


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]


def brute_rank(edges, seeds, p):
    """Personalised PageRank along (a, b, share) with a restart at the seeds; what dangling hosts hold is lost."""
    score = {h: s * (1 - p.damping) for h, s in seeds.items()}
    start = dict(score)
    for _ in range(p.rounds):
        new = dict(start)
        for a, b, share in edges:
            new[b] = new.get(b, 0.0) + p.damping * share * score.get(a, 0.0)
        score = new
    return score


def test_propagation_equals_brute_force(spark):
    """Ranks over a graph with dangling hosts, hosts without pages, several links of one page and cycles."""
    p, links = Propagation(), {"a.com": ["b.io", "c.io"], "b.io": ["bad.net", "b.io"], "c.io": ["bad.net", "a.com", "d.io"], "d.io": [], "e.io": ["bad.net"], "bad.net": ["c.io"]}
    action = {"a.com": "allow", "bad.net": "block"}
    rows = [(h, " ".join(f"<a href='http://{x}/1'>" for x in out for _ in range(2)), action.get(h)) for h, out in links.items()]
    got = {r["host"]: r for r in host_verdicts(spark.createDataFrame(rows, "host string, html string, action string"), p).collect()}
    edges = [(a, b, 1 / len([x for x in out if x != a])) for a, out in links.items() for b in out if b != a]
    trust, distrust = brute_rank(edges, {"a.com": 1.0}, p), brute_rank([(b, a, s) for a, b, s in edges], {"bad.net": 1.0}, p)
    for h in {*trust, *distrust}:
        assert got[h]["trust"] == pytest.approx(trust.get(h, 0) - (1 - p.damping) * (h == "a.com"))
        assert got[h]["distrust"] == pytest.approx(distrust.get(h, 0) - (1 - p.damping) * (h == "bad.net"))
        blocked = got[h]["distrust"] >= p.threshold and got[h]["distrust"] > got[h]["trust"]
        assert got[h]["host_verdict"] == ("block" if blocked else "allow")


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op6_quality_classifier"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id").toPandas()
    good, bad = found[found.quality == 1].score.to_numpy(), found[found.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.95
    assert found[found.quality == 1].predicted.mean() > 0.95


def test_only_letters_have_a_language(spark):
    docs = spark.createDataFrame([(0, "the cat sat", "en"), (1, "der hund sitzt", "de"), (3, "²½Ⅷ ① 12 ́", None), (4, "तो नमस्ते", None)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_predictions(docs).collect()}
    assert got[3] == "und" and got[4] != "und"
    assert words_of("naı̈ve x2y") == ["naı̈ve", "x", "y"]


def test_network_scores_by_plain_loops():
    """The forward pass of every chunk, one after the other, on texts of a few bytes and of many blocks."""
    net = ByteCnn(CnnFit(seed=3))
    net.shift = 0.25
    rng = np.random.default_rng(1)
    texts = [b"", b"a", b"x" * 15, b"y" * 33, bytes(rng.integers(32, 127, 700, np.uint8)), "é漢".encode() * 40, bytes(rng.integers(32, 127, 150_000, np.uint8))]
    w, half = net.w, net.half
    for text, got in zip(texts, net.scores(texts)):
        padded = text + bytes(max(2 * half, -(-len(text) // half) * half) - len(text))
        top = np.full(net.filters, -np.inf)
        for at in range(0, len(padded) - half, half):
            left, right = (w["emb"][list(padded[at + k : at + k + half])].astype(float).ravel() for k in (0, half))
            top = np.maximum(top, left @ w["conv"][:, : net.filters] + right @ w["conv"][:, net.filters :])
        hidden = np.maximum(np.maximum(top + w["cb"], 0) @ w["h"] + w["hb"], 0)
        assert got == pytest.approx(1 / (1 + np.exp(-(hidden @ w["o"] + w["ob"][0] + 0.25))), abs=1e-5)


def test_long_texts_and_repeated_ids_teach_within_bounds(spark):
    """A text beyond the bound teaches nothing, the least of an id's texts does, and the sample's bytes are bounded; all are scored."""
    good, bad = "a calm and useful sentence about things. ", "#### $$$ &&& zzzz %%%% "
    rows = [(i, (good if i % 2 else bad) * (5 + i % 7)) for i in range(120)] + [(1, bad * 50), (500, bad * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(500, 1)], "doc_id bigint, quality int")
    fits = [CnnFit(epochs=2, longest=10_000), CnnFit(epochs=2, longest=10_000, sample_bytes=4_000)]
    for fit in fits:
        a, b = (sorted((r["doc_id"], round(r["score"], 4)) for r in quality_scores(docs.repartition(n), labels, fit).collect()) for n in (2, 7))
        assert a == b and len(a) == len(rows)


def test_language_scores_by_plain_sums(spark):
    """Known words by their log frequency, others by the longest n-grams that are known, against sums word by word."""
    texts = {"de": "der hund und die katze der baum", "en": "the dog and the cat the tree", "xx": "qa qb"}
    model = fit_languages(spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(texts.items())], "doc_id bigint, text string, lang string"))
    assert model.languages == sorted(texts)
    words = {k: t.split() for k, t in texts.items()}
    known = {w for v in words.values() for w in v}

    def logs(keys, counted):
        total = {k: sum(counted[k].values()) for k in counted}
        return {g: [math.log10((counted[k][g] + 0.1) / (total[k] + 0.1 * (len(keys) + 1))) for k in sorted(counted)] for g in keys}

    cut = lambda w, n: [p[i : i + n] for p in [f"<{w}>" if n > 1 else w] for i in range(len(p) - n + 1)]
    of_word = logs(known, {k: Counter(v) for k, v in words.items()})
    of_gram = {n: logs({g for w in known for g in cut(w, n)}, {k: Counter(g for w in v for g in cut(w, n)) for k, v in words.items()}) for n in range(1, 6)}

    def score(word):
        if word in of_word:
            return of_word[word]
        for n in range(5, 0, -1):
            found = [of_gram[n][g] for g in cut(word, n) if g in of_gram[n]]
            if found:
                return [sum(c) / len(found) for c in zip(*found)]
        return [0.0] * 3

    for text in ("der hund", "the unknown dogs", "zzz", "hundert baeume", "qa qb the", "doggy katzen treehouse " * 40):
        total = [sum(c) for c in zip(*(score(w) for w in words_of(text)))]
        best = max(range(3), key=lambda i: total[i])
        lang, share = model.predict_all([text])[0]
        assert lang == model.languages[best]
        assert share == pytest.approx(1 / sum(10 ** (t - total[best]) for t in total))


def test_many_languages_and_many_new_words(spark):
    name = lambda i: chr(97 + i % 26) + chr(97 + i // 26)
    rows = [(i, f"wort{name(i)} andere{name(i)} " * 3, f"l{i:03d}") for i in range(300)]
    model = fit_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(model.languages) == 300
    model._learn({f"neu{name(i)}x" for i in range(70)}, limit=50)
    model._learn({f"alt{name(i)}y" for i in range(70)}, limit=50)
    assert len(model.words) == model.known + 70
    assert [model.predict_all([f"wort{name(i)}"])[0][0] for i in (0, 299)] == ["l000", "l299"]
