from __future__ import annotations

import datetime
import hashlib
import json
import urllib.parse

import pytest

from riskloom.operators import features
from riskloom.sources import archives, files, ingest
from tests.test_sources_and_streams import row, zipped

DAY = 86_400_000


def ms(text):
    return int(datetime.datetime.fromisoformat(text + "+00:00").timestamp() * 1000)


class Archive:
    """Archives and their checksums by URL; tasks get the dictionary's ``get``."""

    def __init__(self):
        self.blobs = {}

    def add(self, symbol, timeframe, month, rows):
        name = urllib.parse.quote(symbol)
        url = f"http://x/{name}/{timeframe}/{name}-{timeframe}-{month}.zip"
        self.blobs[url] = zipped(rows)
        self.blobs[url + ".CHECKSUM"] = hashlib.sha256(self.blobs[url]).hexdigest().encode()
        return url


def filled():
    a = Archive()
    for symbol in ("A B", "1000é"):
        for month in ("2021-01", "2021-02"):
            a.add(symbol, "1d", month, [row(ms(f"{month}-{d:02d}"), close=1 + d / 10) for d in (1, 2, 4)])
    return a


PAIRS = [("A B", "1d"), ("1000é", "1d"), ("NONE", "1d")]


def run(spark, root, archive, end="2021-02", incremental=False, pairs=PAIRS, **more):
    return ingest.ingest(spark, root, pairs, "http://x", "2021-01", end, archive.blobs.get, incremental, tasks=3, **more)


def test_all_pairs_come_in_and_increments_add(spark, tmp_path):
    root, a = str(tmp_path / "candles"), filled()
    first = run(spark, root, a, known_day={"symbol": "A B", "timeframe": "1d", "day": "2021-01-04", "low_below": 1.0, "high_above": 1.5})
    d = ingest.read_table(spark, root)
    assert d.count() == 12 and d.where("symbol = '1000é'").count() == 6
    assert first["errors"] == [] and first["known_day"] is True and len(first["files"]) == 4
    assert first["quality"]["A B/1d"] == {"rows": 6, "duplicates": 0, "gaps": 3, "missing": 29, "empty": 0, "inconsistent": 0, "jumps": 0}
    assert first["quality"]["NONE/1d"] == {"rows": 0}
    assert ingest.quality.manifest_table(archives.read_manifest(spark, f"{root}/{ingest.MANIFEST}")).where("rows = 6").count() == 2
    before = files.read_text(spark, f"{root}/{ingest.MANIFEST}")
    run(spark, root, a, incremental=True)
    assert files.read_text(spark, f"{root}/{ingest.MANIFEST}") == before
    a.add("A B", "1d", "2021-03", [row(ms("2021-03-01"))])
    third = run(spark, root, a, "2021-03", incremental=True, pairs=PAIRS[:1])
    assert third["parts"]["A B/1d"][0] == first["parts"]["A B/1d"][0] and len(third["parts"]["A B/1d"]) == 2
    assert ingest.read_table(spark, root).count() == 13 and third["quality"]["A B/1d"]["rows"] == 7
    assert third["parts"]["1000é/1d"] == first["parts"]["1000é/1d"] and third["known_day"] is True
    assert ingest.snapshot_digest(third) != ingest.snapshot_digest(first)


def test_a_failing_pair_keeps_its_parts_and_the_others_go_on(spark, tmp_path):
    root, a = str(tmp_path / "candles"), filled()
    run(spark, root, a)
    wrong = a.add("A B", "1d", "2021-03", [row(ms("2021-03-01"))])
    a.blobs[wrong + ".CHECKSUM"] = b"0"
    a.add("1000é", "1d", "2021-03", [row(ms("2021-03-01"))])
    second = run(spark, root, a, "2021-03", incremental=True)
    assert len(second["errors"]) == 1 and second["errors"][0].startswith("A B/1d ValueError: checksum")
    assert len(second["parts"]["A B/1d"]) == 1 and len(second["parts"]["1000é/1d"]) == 2
    assert ingest.read_table(spark, root).count() == 13
    a.add("A B", "1d", "2021-03", [row(ms("2021-02-04"))])
    third = run(spark, root, a, "2021-03", incremental=True)
    assert "overlap" in third["errors"][0] and ingest.read_table(spark, root).count() == 13
    a.add("A B", "1d", "2021-03", [row(ms("2021-03-05"))])
    assert run(spark, root, a, "2021-03", incremental=True)["errors"] == []
    assert ingest.read_table(spark, root).count() == 14


def test_changed_parts_and_other_ranges_are_refused(spark, tmp_path):
    root, a = str(tmp_path / "candles"), filled()
    first = run(spark, root, a)
    part = next((tmp_path / "candles" / first["parts"]["A B/1d"][0] / "timeframe=1d" / "symbol=A B").glob("*.parquet"))
    part.with_name(f".{part.name}.crc").unlink(missing_ok=True)
    part.write_bytes(part.read_bytes() + b"x")
    a.add("A B", "1d", "2021-03", [row(ms("2021-03-01"))])
    second = run(spark, root, a, "2021-03", incremental=True)
    assert len(second["errors"]) == 1 and "content" in second["errors"][0] and len(second["parts"]["A B/1d"]) == 1
    with pytest.raises(ValueError, match="increment"):
        run(spark, root, a, "2021-01", incremental=True)


def test_one_run_at_a_time(spark, tmp_path):
    root = str(tmp_path)
    with files.locked(spark, root, "someone"):
        with pytest.raises(files.Busy):
            run(spark, root, filled())
    with files.locked(spark, root, "later"):
        pass
    assert not (tmp_path / files.LOCK).exists()


def index():
    def fetch(url):
        if "currency=BAD" in url:
            return b'{"error": 1}'
        end = int(url.split("end_timestamp=")[1].split("&")[0])
        start = int(url.split("start_timestamp=")[1].split("&")[0])
        days = [t for t in range(start, end + 1, DAY) if t > end - 3 * DAY]
        more = days[0] - 1 if days and days[0] > start else None
        return json.dumps({"result": {"data": [[t, 50, 160, 40, 55] for t in days], "continuation": more}}).encode()

    return fetch


def test_index_of_all_currencies(spark, tmp_path):
    root = str(tmp_path / "index")
    m = ingest.ingest_index(spark, root, ["C", "D", "BAD"], "http://x", "2021-05-15", "2021-05-25", index(), {"symbol": "C", "day": "2021-05-19", "high_above": 100.0})
    d = ingest.read_index(spark, root)
    assert d.count() == 20 and d.select("symbol", "day").distinct().count() == 20 and m["known_day"] is True
    assert m["errors"] == ["BAD ValueError: the index answers 1"] and m["quality"]["C"] == {"n_rows": 10, "duplicates": 0, "missing_days": 0, "out_of_range": 0, "inconsistent": 0}
    again = ingest.ingest_index(spark, root, ["C"], "http://x", "2021-05-15", "2021-05-27", index())
    assert ingest.read_index(spark, root).count() == 22 and again["parts"]["D"] == m["parts"]["D"]


def test_files_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "a.json")
    digest = files.write_json(spark, path, {"b": [1, "é"], "a": None})
    assert hashlib.sha256((tmp_path / "a.json").read_bytes()).hexdigest() == digest
    files.write_json(spark, path, {"b": 2})
    assert files.read_json(spark, path) == {"b": 2} and not files.exists(spark, path + ".staging")
    files.write_outcome(spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b"), str(tmp_path / "rows"))
    assert spark.read.text(str(tmp_path / "rows")).first()[0] == '{"a":1,"b":null}'


def test_settings_and_registered_features(tmp_path):
    path = tmp_path / "s.yaml"
    path.write_text("data:\n  min_start: '2021-01-01'\n", encoding="utf-8")
    settings = files.read_settings(path)
    assert files.setting(settings, "data", "min_start") == "2021-01-01"
    with pytest.raises(KeyError, match="data.other"):
        files.setting(settings, "data", "other")
    path.write_text("a: 1\na: 2\n", encoding="utf-8")
    with pytest.raises(ValueError, match="repeated"):
        files.read_settings(path)
    good = {"source": "daily_rv", "formula": "log rv", "delay_days": 0}
    entries = {"rv_day": good, "rv_week": {**good, "formula": "LOG  rv"}, "new": {**good, "formula": "x"}, "lagged_index": {"source": "vol_index", "formula": "y", "delay_days": 0}, "atr14": {}}
    assert files.feature_problems(entries, features.REGISTRY) == [
        "atr14: no delay_days, formula, source", "lagged_index: differs from its builder", "new: no builder", "rv_week: same variant as rv_day",
    ]
