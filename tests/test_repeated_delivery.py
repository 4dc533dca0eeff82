"""A repeated delivery is recognised by ids, before any body is touched."""

from pyspark.sql import functions as F

from evidence_lake.operators import delivery


def test_a_repeat_touches_no_body_and_a_new_batch_is_still_taken(spark, tmp_path):
    rows = [("a", 0, ["x"]), ("b", 150, ["y", "z"]), ("c", None, ["n"])]
    batches = spark.createDataFrame(rows, "batch_id STRING, tick_index BIGINT, events ARRAY<STRING>")
    batches = batches.where("tick_index IS NOT NULL")
    delivered, parked = str(tmp_path / "delivered"), str(tmp_path / "parked")

    def send(some):
        delivery.write_batches(spark, some, delivered)
        delivery.park(spark, some, F.lit("http_422"), parked, F.lit(5))

    send(batches)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # A body that is read fails the repeat.
        send(batches.withColumn("events", F.raise_error(F.lit("a body was read")).cast("array<string>")))
        send(batches.unionByName(spark.createDataFrame([("d", 150, ["w"])], batches.schema)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    got = spark.read.parquet(delivered).select("batch_id", "tick_day", "events").collect()
    assert sorted((r.batch_id, r.tick_day, r.events) for r in got) == [
        ("a", 0, ["x"]), ("b", 1, ["y", "z"]), ("d", 1, ["w"]),
    ]
    letters = delivery.read_dead_letters(spark, parked).collect()
    assert sorted((r.batch_id, r.reason, r.parked_ns) for r in letters) == [(i, "http_422", 5) for i in "abd"]
