"""The streaming fold against the batch fold, also after a restart from its checkpoint."""

import random

from pyspark.sql import functions as F

from spindle.operators import sequence
from spindle.streaming import bounds


def test_streamed_bounds_are_those_of_the_batch_fold(spark, tmp_path):
    rng = random.Random(4)
    points = {k: sorted(rng.uniform(0, 100) for _ in range(rng.randrange(20, 60))) for k in ("a", "b", "c")}
    cuts = (0.0, 30.0, 30.5, 70.0, 101.0)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, bounds.STORE)
    (tmp_path / "in").mkdir()
    try:
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            rows = [(k, t) for k, own in points.items() for t in own if a <= t < b]
            rng.shuffle(rows)
            rows += [("a", 1.0)] if i == 3 else []
            rows += [(None, 5.0), ("b", None)]
            spark.createDataFrame(rows, "medium string, t double").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
            # Each round is another start of the query, from the checkpoint of the last.
            stream = spark.readStream.schema("medium string, t double").json(str(tmp_path / "in"))
            found = bounds.kept_bounds(stream, "medium", "t", 4.0)
            q = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    frame = spark.createDataFrame(list(points.items()), "medium string, p array<double>")
    want = frame.select("medium", F.explode(sequence.min_gap_fold(F.col("p"), 4.0, 0.0)).alias("b")).collect()
    assert sorted((r["medium"], r["bound"]) for r in got if not r["late"]) == sorted((r["medium"], r["b"]) for r in want)
    assert [(r["medium"], r["bound"]) for r in got if r["late"]] == [("a", 1.0)]
