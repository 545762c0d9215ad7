"""Dropping rows: only those that a filter passes are matched with the list, whatever the size of the list."""

from functools import reduce

from pyspark.sql import functions as F

from slowtrace.llm import contamination, digest_index, minhash
from slowtrace.llm.key_filter import without
from slowtrace.session import scratch_path


def test_texts_are_not_shuffled(spark):
    words = [" ".join(f"w{i}x{j}" for j in range(200)) for i in range(400)]
    rows = [(i, text) for i, text in enumerate(words)] + [(1000 + i, words[i]) for i in range(3)]
    path = scratch_path(spark, "texts")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    docs = spark.read.parquet(path)
    items = spark.createDataFrame([(1, words[7]), (2, words[9])], "item_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with a long list
    try:
        index = digest_index.DigestIndex(spark, scratch_path(spark, "digests"))
        for stage, gone in [
            (lambda: digest_index.drop_exact(docs, index), {0, 1, 2}),
            (lambda: minhash.drop_near(docs), {1000, 1001, 1002}),
            (lambda: contamination.drop_contaminated(docs, items), {7, 9}),
        ]:
            kept = stage()
            assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - gone
            assert _shuffled(kept) < 100  # of 403 rows
        index.close()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _shuffled(df):
    """Rows with a text that went through an exchange."""
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    nodes = [plan.executedPlan()] if "AdaptiveSparkPlan" in plan.nodeName() else [plan]
    while nodes:
        node = nodes.pop()
        if "QueryStage" in node.nodeName():
            nodes.append(node.plan())
            continue
        if node.nodeName() == "Exchange" and "text" in node.output().mkString(" "):
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return total


def test_null_and_repeated_rows(spark):
    rows = [(None, None, "a"), (None, "x", "b"), (1, None, "c"), (1, "x", "d"), (1, "x", "e"), (2, "x", "f")]
    docs = spark.createDataFrame(rows, "doc_id int, key string, name string")
    gone = [spark.createDataFrame([r], "doc_id long, key string") for r in [(None, None), (1, "x"), (1, "x"), (9, None)]]
    left = without(docs, reduce(lambda a, b: a.unionByName(b), gone), "doc_id", "key")
    assert left.columns == docs.columns
    assert sorted(r["name"] for r in left.collect()) == ["b", "c", "f"]
    assert without(docs, gone[0].where(F.lit(False)), "doc_id", "key").count() == len(rows)
