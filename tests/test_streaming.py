"""The stream's closed windows equal those of the table."""

from __future__ import annotations

from lodestar.streaming.rollup import read_events, rollup, write_rollup


def test_rollup(spark, tmp_path):
    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", u, float(h * m + u)) for h in range(6) for m in range(0, 60, 7) for u in (1, 2)]
    df = spark.createDataFrame(rows, "t string, u int, v double").selectExpr("CAST(t AS timestamp) AS ts", "u", "v")
    folder = str(tmp_path / "in")
    for h in range(6):
        df.where(f"hour(ts) = {h}").coalesce(1).write.mode("append").parquet(folder)
    stream = rollup(read_events(spark, folder, "ts timestamp, u int, v double", 1), "ts", "u", "v")
    query = write_rollup(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    query.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = {tuple(r) for r in rollup(df, "ts", "u", "v").collect()}
    last = max(r[0] for r in whole)
    assert got == {r for r in whole if r[0] < last}  # the last window is still open


def test_table(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    got = rollup(events, "ts", "user_id", "value", "1 day")
    assert got.agg({"n": "sum"}).collect()[0][0] == events.count()
