"""The streaming hourly mean equals the batch hourly mean on non-empty hours."""

import uuid

from pyspark.sql import functions as F

from swellcast.operators.grid import hourly_mean
from swellcast.plans import views
from swellcast.session import ensure_checkpoint_dir
from swellcast.streaming.hourly import events_stream, hourly_mean_stream

from conftest import SF_SMALL


def test_stream_matches_batch(spark):
    name = "hourly_" + uuid.uuid4().hex[:8]
    ckpt = ensure_checkpoint_dir(spark).rstrip("/") + "/stream-" + name
    out = hourly_mean_stream(events_stream(spark, SF_SMALL), ["value"])
    q = (out.writeStream.outputMode("append").format("memory").queryName(name)
         .option("checkpointLocation", ckpt).start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql(f"SELECT * FROM {name}")
    batch = hourly_mean(views.obs(spark, SF_SMALL), ["value"]).where(F.col("value").isNotNull())
    # append mode holds back the windows the final watermark has not passed
    last = batch.agg(F.max("ts")).first()[0]
    want = batch.where(F.col("ts") < F.lit(last) - F.expr("INTERVAL 3 HOURS"))
    g = {(r["series_id"], r["ts"]): round(r["value"], 9) for r in got.collect()}
    w = {(r["series_id"], r["ts"]): round(r["value"], 9) for r in want.collect()}
    assert w and all(g.get(k) == v for k, v in w.items())
