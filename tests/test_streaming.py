"""The stream's state agrees with the batch forms."""

from voxelloom.plans import fixtures as X
from voxelloom.streaming import frames as FR

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    f = X.frames(spark, SF).select("session", "frame_id", "ts", *FR.POSE)
    f = f.withColumn("ts", f.ts.cast("timestamp"))
    # Two files in order of time are two micro-batches.
    mid = f.selectExpr("percentile_approx(ts, 0.5) AS m").first().m
    for i, part in enumerate((f.where(f.ts <= mid), f.where(f.ts > mid))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = FR.follow(stream).writeStream.format("memory").queryName("followed").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.frame_id: (round(r.v, 9)) for r in spark.table("followed").collect()}
    want = {r.frame_id: round(r.v, 9) for r in FR.velocity(f).collect()}
    assert got == want
    last = {r.session: round(r.ema, 9) for r in FR.smoothed(f).collect()}
    ordered = {}
    for r in spark.sql("SELECT f.session, f.ema, e.ts FROM followed f JOIN (SELECT * FROM parquet.`%s`) e ON e.frame_id = f.frame_id ORDER BY e.ts, f.frame_id" % (tmp_path / "in")).collect():
        ordered[r.session] = round(r.ema, 9)
    assert ordered == last
