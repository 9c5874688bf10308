from __future__ import annotations

import hashlib
import io
import json
import urllib.parse
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import sequential, thresholds
from riskloom.plans import comparison
from riskloom.sources import archives
from riskloom.streaming import bars as streams


def zipped(rows, header=False, names=("x.csv",)):
    text = (",".join(archives.ARCHIVE_COLUMNS) + "\n") * header + "\n".join(",".join(map(str, r)) for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in names:
            z.writestr(name, text)
    return out.getvalue()


def row(ms, close=1.5):
    return (ms, 1, 2, 0.5, close, 10, ms + 299_999, 15, 7, 5, 7.5, 0)


def test_archives_are_parsed_by_spark(spark, tmp_path):
    january = 1_609_459_200_000
    (tmp_path / "A-5m-2021-01.zip").write_bytes(zipped([row(january), row(january + 300_000)], header=True))
    (tmp_path / f"{urllib.parse.quote('1000é')}-5m-2025-01.zip").write_bytes(zipped([row(1_735_689_600_000_000)]))
    got = sorted((r.symbol, r.month, r.ts.isoformat(), r["count"]) for r in archives.read_archives(spark, str(tmp_path)).collect())
    assert got[1:] == [("A", "2021-01", "2021-01-01T00:00:00", 7), ("A", "2021-01", "2021-01-01T00:05:00", 7)]
    assert got[0][0] == "1000é" and got[0][2] == "2025-01-01T00:00:00"
    with pytest.raises(ValueError, match="one file"):
        archives.parse_zip(zipped([row(january)], names=("a.csv", "b.csv")))


def test_checksums_and_months(spark):
    blob = zipped([row(1)])
    good = {"u": blob, "u.CHECKSUM": hashlib.sha256(blob).hexdigest().encode() + b"  name"}
    assert archives.download(good.get, "u")[0] == blob
    assert archives.download(good.get, "missing") is None
    with pytest.raises(ValueError, match="checksum"):
        archives.download(({"u": blob}).get, "u")
    pairs = spark.createDataFrame([("A B", "5m")], "symbol string, timeframe string")
    urls = [r.url for r in archives.month_urls(pairs, "b", "2021-11", "2022-01").orderBy("month").collect()]
    assert urls[0] == "b/A%20B/5m/A%20B-5m-2021-11.zip" and len(urls) == 3
    assert archives.incremental_range(None, "2021-01", "2021-03") == "2021-01"
    assert archives.incremental_range({"start": "2021-01", "end": "2021-12"}, "2021-01", "2022-03") == "2022-01"
    with pytest.raises(ValueError):
        archives.incremental_range({"start": "2021-01", "end": "2021-12"}, "2021-01", "2021-11")


def test_pages_are_followed_until_they_end(spark):
    day = 86_400_000
    def fetch(url):
        end = int(url.split("end_timestamp=")[1].split("&")[0])
        data = [[t, 50, 60, 40, 55] for t in range(max(0, end - 2 * day), end, day)]
        return json.dumps({"result": {"data": data, "continuation": end - 2 * day if end > 2 * day else None}}).encode()

    pages = archives.index_pages(fetch, "http://x", "C", 0, 6 * day)
    d = archives.parse_pages(spark, pages, "C")
    assert len(pages) == 3 and d.select("day").distinct().count() == 6
    assert archives.full_days(d, "1970-01-04").count() == 3
    with pytest.raises(ValueError, match="answers"):
        archives.index_pages(lambda u: b'{"error": {"code": 1}}', "http://x", "C", 0, 1)


def test_append_refuses_overlaps(spark, tmp_path):
    path = str(tmp_path / "candles")
    old = spark.createDataFrame([("A", "1d", "2021-01-01", 1.0), ("A", "1d", "2021-01-02", 2.0)], "symbol string, timeframe string, t string, close double").select("symbol", "timeframe", F.to_timestamp("t").alias("ts"), "close")
    archives.write_table(old, path)
    later = old.withColumn("ts", F.col("ts") + F.expr("interval 2 days"))
    assert archives.append_months(spark, path, later) == 2
    with pytest.raises(ValueError, match="overlap"):
        archives.append_months(spark, path, later)
    archives.write_table(old, path)
    assert spark.read.parquet(path).count() == 2


def test_loader_floor_and_nan(spark, tmp_path):
    path = str(tmp_path / "c.parquet")
    spark.createDataFrame([("2020-12-31", 1.0), ("2021-01-01", float("nan")), ("2021-01-02", 3.0)], "t string, close double").select(F.to_timestamp("t").alias("ts"), "close").write.parquet(path)
    d = archives.load_candles(spark, path)
    assert d.count() == 2 and d.where("close is null").count() == 1
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan
    with pytest.raises(ValueError, match="parquet or csv"):
        archives.load_candles(spark, "x.json")


def test_registry_file(spark, tmp_path):
    path = tmp_path / "r.csv"
    lines = [",".join(thresholds.COLUMNS), "1,2024-01-01,r,2024-01-01_a,inna,werdykt,tak,2,u", '2,2023-01-01,r,2024-01-01_a,inna,werdykt,tak,x,"a, b"']
    path.write_text("﻿" + "\n".join(lines), encoding="utf-8")
    d = archives.read_registry(spark, str(path))
    errors = {(r["at"], r.error) for r in thresholds.registry_errors(d).collect()}
    assert errors == {(2, "date order"), (2, "folder prefix"), (2, "duplicate folder"), (2, "variants not a number")}
    assert thresholds.counted(d, 1).first().asDict() == {"n_program": 2, "n_variants": 2}


def test_streamed_bars_equal_batch_bars(spark, sf_dir, tmp_path):
    from riskloom.sources import adapters

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = str(tmp_path / "events")
    events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("event_id long, ts timestamp, event_type string, value double").parquet(path)
    query = streams.stream_bars(stream).writeStream.format("memory").queryName("bars").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("bars")
    want = adapters.bars(spark, sf_dir).select(got.columns)
    assert got.exceptAll(want).isEmpty()
    assert got.count() >= want.count() - 5 * 4  # the last minutes are still open


def test_streamed_evidence_keeps_its_state(spark, tmp_path):
    path = str(tmp_path / "returns")
    rng = np.random.default_rng(0)
    for _ in range(3):
        spark.createDataFrame([("A", float(x)) for x in rng.normal(0, 1, 50)], "symbol string, r double").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("symbol string, r double").option("maxFilesPerTrigger", 1).parquet(path)
    query = streams.stream_evidence(stream, 0.0, 1.0, 0.5, 1).writeStream.format("memory").queryName("evidence").outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    last = spark.table("evidence").orderBy(F.desc("t")).first()
    total = spark.read.parquet(path).agg(F.sum("r")).first()[0]
    assert last.t == 150 and last.s == pytest.approx(total)
    assert last.e == pytest.approx(float(np.exp(sequential.log_e(np.array([total]), np.array([150.0]), 0.5, 1))[0]))


def test_comparison_stops_where_its_protocol_says(spark, sf_dir):
    from dataclasses import replace

    from riskloom.operators import universe
    from riskloom.sources import adapters

    days = adapters.daily_variance(spark, sf_dir.replace("sf0.001", "sf0.01")).where("symbol in ('AF', 'AO') and rv > 0")
    s = replace(universe.Settings(), k_min=2, reps=20)
    planned = comparison.run(spark, days, None, np.linspace(0, 0.5, 6), s=s, days_only=True)
    registered = spark.createDataFrame(planned.tests, "symbol string, n_days long, fingerprint string")
    assert comparison.run(spark, days, registered.limit(1), [0.1], s=s).stage == "registration"
    assert comparison.run(spark, days, registered, np.linspace(0, 0.5, 6), s=s, largest_mde=0.0).stage == "gate"
    out = comparison.run(spark, days, registered, np.linspace(0, 2, 9), s=s, largest_mde=5.0)
    assert out.stage == "test" and out.verdict["k"] == 2
    assert comparison.run(spark, days, registered, [0.1], s=replace(s, k_min=3)).stage == "selection"
