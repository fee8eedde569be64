"""Streaming ingest and running scores."""

import os

from seriescast.streaming.ingest import commit_batch, ingest, running_scores


def test_ingest_and_running_scores(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "s1.csv").write_text("-BEGIN HEADER-\nx\n-END HEADER-\nYEAR,MO,DY,T2M\n2024,1,1,-999\n2024,1,2,3.0\n")
    (src / "s2.csv").write_text("YEAR,MO,DY,T2M\n2024,1,1,5.0\n")
    out = str(tmp_path / "out")
    q = ingest(spark, str(src), out, str(tmp_path / "ck"), params=["T2M"])
    q.awaitTermination(120)
    got = spark.read.parquet(out).orderBy("site", "ts").collect()
    assert [(r.site, str(r.ts), r.T2M) for r in got] == [
        ("s1", "2024-01-01", None), ("s1", "2024-01-02", 3.0), ("s2", "2024-01-01", 5.0)]

    pred_dir = tmp_path / "pred"
    pred_dir.mkdir()
    spark.createDataFrame([("T2M", 10.0, 10.5), ("T2M", 10.0, 20.0), ("PS", 90.0, 90.0)],
                          "param string, actual double, predicted double").write.parquet(str(pred_dir / "b1"))
    stream = spark.readStream.schema("param string, actual double, predicted double").parquet(str(pred_dir / "b1"))
    sq = (running_scores(stream).writeStream.outputMode("complete").format("memory")
          .queryName("scores_t").trigger(availableNow=True).start())
    sq.awaitTermination(120)
    rows = {r.param: r for r in spark.sql("SELECT * FROM scores_t").collect()}
    assert rows["T2M"].n == 2 and rows["T2M"].in_range == 1 and rows["PS"].in_range_pct == 100.0
    assert os.path.isdir(out)


def test_replayed_batch_is_written_once(spark, tmp_path):
    out = str(tmp_path / "out")
    lines = lambda site, temp: spark.createDataFrame(
        [("YEAR,MO,DY,T2M", f"/in/{site}.csv"), (f"2024,1,1,{temp}", f"/in/{site}.csv")], "line string, _file string")
    commit_batch(lines("s1", 1.0), 0, out, ["T2M"])
    commit_batch(lines("s2", 2.0), 1, out, ["T2M"])
    commit_batch(lines("s2", 2.0), 1, out, ["T2M"])     # the engine did not see the commit
    commit_batch(lines("s1", 3.0), 2, out, ["T2M"])     # a later file of a known site
    got = sorted((r["batch"], r["site"], r["T2M"]) for r in spark.read.parquet(out).collect())
    assert got == [(0, "s1", 1.0), (1, "s2", 2.0), (2, "s1", 3.0)]
