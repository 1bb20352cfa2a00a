"""Further columns of clashing names, and repeated rows, for searches and judges that tests elsewhere leave out."""

from pyspark.sql import functions as F

from docweave.llm.ann import nearest_neighbours
from docweave.llm.quality_cnn import CnnFit, quality_scores
from docweave.llm.url_filter import filter_urls


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def clashing(df, *names):
    """Columns of the operators' own names behind the table's, and of its names in other case before them."""
    return df.select(*[F.lit("no").alias(n.upper()) for n in df.columns], "*", *[F.lit(7).alias(n) for n in names if n not in df.columns])


def test_url_verdicts(spark):
    urls = ["http://a.example.com/en/x", "https://www.example.com/en/", "ftp://b.net/es/?q", None, "nothing", "http://A.COM", "http://b.net/es/?q"]
    pages = spark.createDataFrame([(i, u, "<a href='http://c.net/'>x</a>") for i, u in enumerate(urls)] + [(2, urls[2], None)], "page_id bigint, url string, html string")
    want = rows(filter_urls(pages))
    assert rows(filter_urls(clashing(pages, "host", "path", "rule", "verdict", "src", "dst", "links"))) == want
    assert len(want) == len(urls) + 1 and [r for r in want if r[0] == 2][0] == [r for r in want if r[0] == 2][1]
    assert rows(filter_urls(pages.limit(0))) == []


def test_neighbours(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5) - 2.0, 1.0 + i % 3]) for i in range(90)] + [(90, None), (91, [0.0, 0.0, 0.0])], "vec_id bigint, embedding array<float>")
    want = rows(nearest_neighbours(vectors))
    assert rows(nearest_neighbours(clashing(vectors, "score", "rank", "query_id", "part", "norm"))) == want
    twice = rows(nearest_neighbours(vectors.unionByName(vectors.where("vec_id in (20, 33)"))))
    assert {r[0] for r in twice} == {r[0] for r in want} == {0, 20, 40, 60, 80}


def test_quality_scores(spark, odd, clash):
    labels = spark.createDataFrame([(0, 1), (3, 0), (4, 0), (7, 1)], "doc_id bigint, quality int")
    fit = CnnFit(epochs=1)
    assert rows(quality_scores(clash, clashing(labels, "text", "score", "fold"), fit)) == rows(quality_scores(odd, labels, fit))
