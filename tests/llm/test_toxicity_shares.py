from pyspark.sql import functions as F

from meshlake.llm import toxicity


def test_cap_does_not_move_the_share(spark):
    """Texts that tell nothing score the share of all labels, whatever part of a class is learnt from."""
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("plain words").alias("text"), (F.col("id") % 10 == 0).cast("int").alias("toxic"))
    known = rows.where(~toxicity.held_out("doc_id")).agg(F.avg("toxic")).first()[0]
    for cap in (50, 400, 4000):
        m = toxicity.train(rows, rows, "doc_id", "text", "toxic", per_class=cap)
        got = toxicity.score(spark.createDataFrame([(None,)], "text string"), "text", m).first().score
        assert abs(got - known) < 0.08, (cap, got, known)
