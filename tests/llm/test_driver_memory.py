"""What the driver holds of a job: plans stay small, whatever the number of levels."""

from pyspark.sql import functions as F

from rasterloom.llm import toxicity


def test_levels_of_beginnings_join_one_table_each(spark, monkeypatch):
    """A level backs off to the level before it only; counts of all levels come from one exchange."""
    leaves = {}
    scratch = toxicity.scratch

    def counted(df, label):
        leaves[label] = df._jdf.queryExecution().analyzed().collectLeaves().size()
        return scratch(df, label)

    monkeypatch.setattr(toxicity, "scratch", counted)
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("commonwealth alphabetical"), F.concat(F.lit("wordbeginning"), F.col("id") % 7)).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 7 == 0).cast("int").alias("toxic"))
    assert toxicity.op10(docs, labels).count() == 60
    stems = [n for label, n in leaves.items() if label.startswith("stems")]
    assert len(stems) == 1 + len(toxicity.LEVELS) and max(stems) == 2
