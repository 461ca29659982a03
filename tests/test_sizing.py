from pyspark.sql import functions as F

from starcell.plans.sizing import broadcast_if_small, fits_broadcast


def test_size_is_proven(spark):
    rows = spark.range(100)
    assert fits_broadcast(rows) and not fits_broadcast(rows, max_rows=99)
    text = rows.select(F.lpad(F.col("id").cast("string"), 1000, "0").alias("t"))
    assert fits_broadcast(text) and not fits_broadcast(text, max_bytes=99_999)
    assert not fits_broadcast(rows.select(F.array("id").alias("a")))


def test_no_hint_beyond_the_bound(spark):
    side = spark.range(100)
    for bound, hinted in ((100, True), (99, False)):
        plan = broadcast_if_small(side, bound)._jdf.queryExecution().analyzed().toString()
        assert ("broadcast" in plan) == hinted
