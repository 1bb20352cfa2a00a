"""What an ingest leaves on disk is its tables alone."""

from docweave.operators import ingest
from docweave.sources.storage import scratch
from docweave.sources.versions import TableStore


def test_a_commit_leaves_no_plan_behind(spark):
    """The texts of a batch lie in its nodes; a second copy of them, which the plan was, is gone with the commit."""
    store = TableStore(spark, scratch(spark, "library"))
    docs = [(i, f"s{i}", f"words of document {i} " * 40) for i in range(6)]
    for text in ("", "and more"):
        rows = [(i, s, t + text if i % 2 else t) for i, s, t in docs]
        library = ingest.ingest(store, spark.createDataFrame(rows, "doc_id bigint, source string, text string"))
        assert store.files.names(f"{store.path}/data/work") == []
        assert library.registry.where("state = 'indexed'").count() == 6 and library.index.nodes().count() == library.nodes.count()
