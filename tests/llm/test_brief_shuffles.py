"""The exchanges of substring deduplication leave no files behind while later steps run."""

from strataq.llm import substrings

KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_steps_delete_their_shuffle_files(spark):
    before_setting = spark.conf.get(KEY)
    shuffles = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    rows = [(k, f"{k} some words that stand before the passage; " + "a passage that all of the texts have in common, word for word " * 2) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = shuffles.size()
    out = substrings.deduplicate(docs)
    assert shuffles.size() <= before  # the last step has not run yet
    assert spark.conf.get(KEY) == before_setting
    removed = {r.doc_id: r.n_removed for r in out.collect()}
    assert removed[0] == 0 and all(removed[k] > 100 for k in range(1, 40))
    assert {r.doc_id: r.n_removed for r in out.collect()} == removed
