import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from trailmark.sources import ingest, model
from trailmark.streaming import postings


def test_document(spark, tmp_path):
    doc = {
        "profile": "p", "dataset_id": "d", "closure": {"version": "1", "ancestors": {"a": ["top"], "top": []}},
        "patients": [{"patient_id": "x", "clock_id": "utc", "events": [{"event_id": "e1", "concepts": ["a", "a"], "source": "s", "start": [1, 3]}, {"event_id": "e2", "concepts": ["top"], "source": "s", "start": [2, 2], "end": [5, None]}], "coverage": [{"source": "s", "lo": 0, "hi": 9, "basis": "b"}], "excluded": [{"source": "s", "concept": "a", "start": [4, 5], "reason": "r"}], "series": []}],
    }
    (tmp_path / "doc.json").write_text(json.dumps(doc))
    found = ingest.read_document(spark, str(tmp_path / "doc.json"))
    rows = {r.event_id: r for r in found["events"].collect()}
    assert (rows["e1"].end_lo, rows["e1"].end_hi, rows["e1"].ongoing) == (1, 3, False) and (rows["e2"].end_hi, rows["e2"].ongoing) == (None, True)
    assert found["event_concepts"].count() == 2 and found["coverage"].count() == 1 and found["series"].count() == 0
    assert {tuple(r) for r in found["closure"].collect()} == {("a", "a"), ("a", "top"), ("top", "top")} and found["excluded"].first().x_hi == 5


def test_csv_header_is_checked(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,v\n1,2.5\n")
    assert ingest.read_table(spark, str(tmp_path / "t.csv"), "id long, v double").first().v == 2.5
    with pytest.raises(Exception):
        ingest.read_table(spark, str(tmp_path / "t.csv"), "id long, other double").collect()
    (tmp_path / "bad.csv").write_text("id,v\nx,2.5\n")
    with pytest.raises(Exception):
        ingest.read_table(spark, str(tmp_path / "bad.csv"), "id long, v double").collect()


def test_days_in_text(spark):
    texts = ["seen 2024-02-30 and 2024-02-28", "on 3/4/2020, again 2020-03-04", "am 4.3.2020", "none", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", ingest.mention_days(F.col("t")).alias("d")).collect()
    got = {r.i: r.d for r in rows}
    day = dt.date(2020, 3, 4)
    assert got[0] == [dt.date(2024, 2, 28)] and got[1] == [day] and got[2] == [day] and got[3] == [] and not got[4]
    lo, hi = (F.lit(x).cast("date") for x in ("2020-01-01", "2020-12-31"))
    out = spark.createDataFrame([("am 4.3.2020",), ("2019-01-01",), ("x",)], "t string").withColumns(ingest.narrowed(lo, hi, ingest.mention_days(F.col("t")))).collect()
    assert [(r.lo == day, r.narrowed) for r in out] == [(True, True), (False, False), (False, False)]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(p, 10 * p + i, ["view", "purchase"][i % 2], dt.datetime(2024, 1, 1 + i // 4, 3 * (i % 4))) for p in range(3) for i in range(9)], "patient long, event_id long, kind string, ts timestamp")
    rows.unionByName(rows.limit(4)).repartition(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    closure = model.closure(spark)
    out = postings.daily_postings(stream, closure).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    out.awaitTermination(120)
    closed = spark.read.parquet(f"{tmp_path}/out")
    last = closed.agg(F.max("day")).first()[0]
    want = model.with_concepts(rows.filter(F.col("ts") < F.lit(last) + F.expr("INTERVAL 1 DAY")), closure).groupBy("patient", "concept").agg(F.count("*").alias("n"))
    got = postings.folded(closed).select("patient", "concept", "n")
    assert closed.count() > 0 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    pairs = postings.followed_within(stream.filter("kind = 'view'"), stream.filter("kind = 'purchase'"), "4 HOURS").writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/pairs").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    pairs.awaitTermination(120)
    found = {(r.a_id, r.b_id) for r in spark.read.parquet(f"{tmp_path}/pairs").collect()}
    everything = rows.collect()
    assert found == {(a.event_id, b.event_id) for a in everything for b in everything if a.patient == b.patient and a.kind == "view" and b.kind == "purchase" and 0 <= (b.ts - a.ts).total_seconds() <= 4 * 3600}
