"""Ingest of all (symbol, timeframe) pairs, or of all index currencies, as one operation.

A run fetches in tasks, one file each, and writes what it got in a folder of its own. The manifest then names, pair by
pair, the parts that count; replacing it is the one step in which a run takes effect. A pair that fails (network,
checksum, archive, overlap with what is there) is listed with its error and keeps its old parts and entries; the other
pairs go on. A run that dies leaves the old manifest, and so the old table, and a folder that nothing refers to.

An increment fetches only the months after a pair's last one, adds parts and never rewrites old ones. Old parts must
still have the content that the manifest recorded; rows are never dropped to make parts fit.
"""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators import quality
from riskloom.sources import archives, files

MANIFEST = "manifest.json"
STEP_SECONDS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "1d": 86400}
KEYS = ("symbol", "timeframe", "month", "url")
LANDED = T.StructType([T.StructField(c, T.StringType()) for c in (*KEYS, "sha256", "error")] + archives.CANDLES.fields)
PAGES = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("at", T.IntegerType())] + [T.StructField(c, T.StringType()) for c in ("page", "sha256", "error")])
FIELD_OF = {"rows": "n_rows", "duplicates": "duplicates", "gaps": "n_gaps", "missing": "missing_intervals", "empty": "empty_candles", "inconsistent": "inconsistent", "jumps": "n_jumps"}


def said(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def land(urls: DataFrame, fetch: archives.Fetch, tasks: int) -> DataFrame:
    """Candles of every archive, and for each archive one row without candles that has its digest or its error; a month
    for which there is no archive has neither row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key in batch[list(KEYS)].itertuples(index=False):
                sha256 = error = None
                candles = pd.DataFrame(columns=[f.name for f in archives.CANDLES.fields])
                try:
                    got = archives.download(fetch, key.url)
                    if got is None:
                        continue
                    candles, sha256 = archives.parse_zip(got[0]), got[1]
                except Exception as e:  # whatever it is, it is this pair's error and not the run's
                    error = said(e)
                yield pd.DataFrame([{**key._asdict(), "sha256": sha256, "error": error}]).reindex(columns=LANDED.names).astype({c: object for c in LANDED.names})
                if len(candles):
                    yield candles.assign(**key._asdict(), sha256=None, error=None)[LANDED.names]

    return urls.repartition(tasks, "symbol", "timeframe", "month").mapInPandas(run, LANDED)


def months_after(entries: list[dict], start: str) -> str:
    """The month after the last entry's, or the start."""
    if not entries:
        return start
    year, month = map(int, max(e["month"] for e in entries).split("-"))
    return f"{year + month // 12}-{month % 12 + 1:02d}"


def by_pair(entries: list[dict]) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for e in entries:
        out.setdefault(f"{e['symbol']}/{e['timeframe']}", []).append(e)
    return out


def parts_of(manifest: dict) -> list[tuple[str, str]]:
    return [(pair, run) for pair, parts in manifest["parts"].items() for run in parts]


def folder(root: str, run: str, pair: str) -> str:
    symbol, timeframe = pair.split("/")
    return f"{root.rstrip('/')}/{run}/timeframe={timeframe}/symbol={symbol}"


def digests(spark: SparkSession, root: str, parts: list[tuple[str, str]]) -> dict[tuple[str, str], str]:
    """A digest of each part's files, read by tasks; the driver gets 64 characters a file and of missing parts nothing."""
    present = {(p, r): folder(root, r, p) for p, r in parts if files.exists(spark, folder(root, r, p))}
    if not present:
        return {}
    each = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(list(present.values())).select(
        F.regexp_extract("path", "/([^/]+)/timeframe=([^/]+)/symbol=([^/]+)/", 1).alias("run"),
        F.concat(F.url_decode(F.regexp_extract("path", "/symbol=([^/]+)/", 1)), F.lit("/"), F.regexp_extract("path", "/timeframe=([^/]+)/", 1)).alias("pair"),
        F.sha2("content", 256).alias("d"),
    )
    whole = each.groupBy("pair", "run").agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("d"))), 256).alias("d"))
    return {(r.pair, r.run): r.d for r in whole.collect()}


def read_table(spark: SparkSession, root: str, manifest: dict | None = None) -> DataFrame:
    """The candles that the manifest names."""
    manifest = manifest or files.read_json(spark, f"{root.rstrip('/')}/{MANIFEST}")
    runs: dict[str, list[str]] = {}
    for pair, run in parts_of(manifest):
        runs.setdefault(run, []).append(folder(root, run, pair))
    schema = T.StructType(archives.CANDLES.fields + [T.StructField("timeframe", T.StringType()), T.StructField("symbol", T.StringType())])
    out = spark.createDataFrame([], schema)
    for run, paths in sorted(runs.items()):
        one = spark.read.schema(schema).option("basePath", f"{root.rstrip('/')}/{run}").parquet(*paths)
        out = out.unionByName(one.select(*schema.names))
    return out


def quality_of(candles: DataFrame) -> dict[str, dict[str, int]]:
    """The quality counts of each pair, with the names of ``quality.QUALITY_FIELDS``."""
    out = {}
    for (timeframe,) in candles.select("timeframe").distinct().collect():
        d = candles.where(F.col("timeframe") == timeframe).withColumn("day", F.to_date("ts"))
        for r in quality.report(d, STEP_SECONDS[timeframe]).collect():
            out[f"{r.symbol}/{timeframe}"] = {name: r[c] for name, c in FIELD_OF.items()}
    return out


def _checked_previous(previous: dict | None, start: str, end: str) -> None:
    if previous is not None:
        archives.incremental_range({"start": previous["start"], "end": previous["end"]}, start, end)


def ingest(
    spark: SparkSession, root: str, pairs: list[tuple[str, str]], base: str, start: str, end: str, fetch: archives.Fetch = archives.fetch_http,
    incremental: bool = False, tasks: int = 64, known_day: dict | None = None,
) -> dict:
    """Brings the pairs' months from start to end (YYYY-MM) in, under the directory's lock, and returns the manifest.

    ``known_day`` has a symbol, a timeframe, a day and the extremes ``low_below`` and ``high_above`` that it must have.
    An increment in which nothing is new or wrong, and was not before, writes nothing.
    """
    root = root.rstrip("/")
    run = f"run-{datetime.datetime.now(datetime.UTC):%Y%m%dT%H%M%S%f}"
    fs, where = files._file_system(spark, root)
    fs.mkdirs(where)
    with files.locked(spark, root, run):
        previous = files.read_json(spark, f"{root}/{MANIFEST}") if incremental else None
        _checked_previous(previous, start, end)
        manifest = _run(spark, root, run, pairs, base, start, end, fetch, previous, tasks, known_day)
        if manifest is not previous:
            files.write_json(spark, f"{root}/{MANIFEST}", manifest)
        return manifest


def _run(spark, root, run, pairs, base, start, end, fetch, previous, tasks, known_day) -> dict:
    old = previous or {"files": [], "quality": {}, "parts": {}, "digests": {}, "errors": []}
    entries, names = by_pair(old["files"]), [f"{s}/{t}" for s, t in dict.fromkeys(pairs)]
    errors = _changed_parts(spark, root, old, names)
    since = {name: months_after(entries.get(name, []), start) for name in names}
    due = [(*name.split("/"), since[name]) for name in names if name not in errors and since[name] <= end]
    landed_at = f"{root}/{run}-landed"
    fresh = _land(spark, due, base, end, fetch, tasks, landed_at) if due else {}
    errors |= {name: "; ".join(x["error"] for x in got if x["error"]) for name, got in fresh.items() if any(x["error"] for x in got)}
    landed = spark.read.parquet(landed_at).where("open_time is not null") if due else None
    before = read_table(spark, root, {"parts": {n: p for n, p in old["parts"].items() if n in names and n not in errors}})
    if fresh:
        errors |= _overlaps(landed, before, [n for n in fresh if n not in errors])
    added = [n for n in fresh if n not in errors]
    if added:
        own = spark.createDataFrame([tuple(n.split("/")) for n in added], "symbol string, timeframe string")
        kept = landed.join(F.broadcast(own), ["symbol", "timeframe"]).select(*archives.CANDLES.names, "timeframe", "symbol")
        kept.repartition("timeframe", "symbol", F.date_trunc("year", "ts")).sortWithinPartitions("timeframe", "symbol", "ts").write.partitionBy("timeframe", "symbol").parquet(f"{root}/{run}")
    if due:
        files.remove(spark, landed_at)
    if previous is not None and not added and not errors and not previous["errors"]:
        files.remove(spark, f"{root}/{run}")
        return previous
    # pairs that this run doesn't name stay as they were
    everyone = [*names, *sorted({*old["parts"], *entries} - set(names))]
    parts = {n: p for n in everyone if (p := old["parts"].get(n, []) + [run] * (n in added and files.exists(spark, folder(root, run, n))))}
    new = digests(spark, root, [(n, run) for n in added])
    manifest = {
        "version": "1", "source": base, "created": run.removeprefix("run-"), "start": start, "end": end, "parts": parts,
        "files": [{k: e[k] for k in (*KEYS, "sha256")} for n in everyone for e in entries.get(n, []) + (sorted(fresh[n], key=lambda e: e["month"]) if n in added else [])],
        "digests": old["digests"] | {f"{r}/{n}": d for (n, r), d in new.items()}, "errors": [f"{n} {e}" for n, e in sorted(errors.items())],
    }
    counts = quality_of(read_table(spark, root, {"parts": {n: parts[n] for n in added if n in parts}})) if added else {}
    # a pair without any archive counts as read by a full run, with no rows
    empty = {n for n in names if n not in errors and (n in added or previous is None)}
    manifest["quality"] = {n: q for n in everyone if (q := counts.get(n, {"rows": 0} if n in empty else old["quality"].get(n)))}
    if "known_day" in old:
        manifest["known_day"] = old["known_day"]
    if known_day and f"{known_day['symbol']}/{known_day['timeframe']}" in added:
        d = read_table(spark, root, manifest).where((F.col("symbol") == known_day["symbol"]) & (F.col("timeframe") == known_day["timeframe"]))
        found = quality.known_day_control(d.withColumn("day", F.to_date("ts")), known_day["day"], known_day.get("low_below"), known_day.get("high_above")).first()
        manifest["known_day"] = bool(found and found.ok)
    return manifest


def _changed_parts(spark, root, old, names) -> dict[str, str]:
    """Pairs whose parts are no longer what the manifest recorded, or that have entries without parts' counts."""
    wanted = [(n, r) for n, r in parts_of(old) if n in names]
    now = digests(spark, root, wanted)
    bad = {n: "ValueError: the part is gone or its content isn't the manifest's" for n, r in wanted if now.get((n, r)) != old["digests"].get(f"{r}/{n}")}
    return bad | {n: "ValueError: the manifest has files but no quality counts" for n in names if n in by_pair(old["files"]) and n not in old["quality"]}


def _land(spark, due, base, end, fetch, tasks, path) -> dict[str, list[dict]]:
    """Writes what the pairs' months give and returns their files' rows; a pair without archives has none."""
    urls = None
    for since in sorted({d[2] for d in due}):
        some = spark.createDataFrame([d[:2] for d in due if d[2] == since], "symbol string, timeframe string")
        more = archives.month_urls(some, base, since, end)
        urls = more if urls is None else urls.unionByName(more)
    land(urls, fetch, tasks).write.parquet(path)
    rows = spark.read.parquet(path).where("open_time is null").select(*KEYS, "sha256", "error").collect()
    return by_pair([r.asDict() for r in rows])


def _overlaps(landed, before, names) -> dict[str, str]:
    """Pairs whose new rows repeat times or don't all lie after the old ones."""
    keys = ["symbol", "timeframe"]
    last = before.groupBy(*keys).agg(F.max("ts").alias("last"))
    span = landed.groupBy(*keys).agg(F.min("ts").alias("first"))
    late = span.join(last, keys).where("first <= last").select(*keys, F.concat(F.lit("ValueError: new rows from "), "first", F.lit(" on overlap the old ones to "), "last").alias("e"))
    return {n: r.e for r in late.collect() if (n := f"{r.symbol}/{r.timeframe}") in names}


# ---------------------------------------------------------------- index


def ingest_index(spark: SparkSession, root: str, currencies: list[str], base: str, start: str, end: str, fetch: archives.Fetch = archives.fetch_http, known_day: dict | None = None) -> dict:
    """Brings the daily index of all currencies in, from ``start`` to the day before ``end``, and returns the manifest.

    Each currency's pages follow one another in one task. A failing currency is listed and keeps its old part.
    """
    root = root.rstrip("/")
    run = f"run-{datetime.datetime.now(datetime.UTC):%Y%m%dT%H%M%S%f}"
    fs, where = files._file_system(spark, root)
    fs.mkdirs(where)
    ms = lambda day: int(datetime.datetime.fromisoformat(day).replace(tzinfo=datetime.UTC).timestamp() * 1000)
    first, last = ms(start), ms(end) - 1

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for symbol in batch["symbol"]:
                try:
                    found = archives.index_pages(fetch, base, symbol, first, last)
                    yield pd.DataFrame([(symbol, i, page, sha256, None) for i, (page, sha256) in enumerate(found)], columns=PAGES.names)
                except Exception as e:  # this currency's error
                    yield pd.DataFrame([(symbol, None, None, None, said(e))], columns=PAGES.names)

    with files.locked(spark, root, run):
        path = f"{root}/{MANIFEST}"
        old = files.read_json(spark, path) if files.exists(spark, path) else {"parts": {}, "quality": {}, "pages": []}
        wanted = list(dict.fromkeys(currencies))
        spark.createDataFrame([(c,) for c in wanted], "symbol string").repartition(max(1, len(wanted)), "symbol").mapInPandas(pages, PAGES).write.parquet(f"{root}/{run}-landed")
        landed = spark.read.parquet(f"{root}/{run}-landed")
        errors = {r.symbol: r.error for r in landed.where("error is not null").collect()}
        good = [c for c in wanted if c not in errors]
        rows = archives.parsed(landed.where("error is null and at is not null"))
        archives.full_days(rows, end).where(F.col("day") >= F.lit(start).cast("date")).repartition("symbol").sortWithinPartitions("symbol", "ts").write.partitionBy("symbol").parquet(f"{root}/{run}/index")
        got = [r.asDict() for r in landed.where("at is not null").orderBy("symbol", "at").select("symbol", "sha256").collect()]
        files.remove(spark, f"{root}/{run}-landed")
        parts = old["parts"] | {c: run for c in good}
        manifest = {
            "version": "1", "source": base, "created": run.removeprefix("run-"), "start": start, "end": end, "parts": parts,
            "pages": [p for p in old["pages"] if p["symbol"] not in good] + got, "errors": [f"{c} {e}" for c, e in sorted(errors.items())],
        }
        index = read_index(spark, root, manifest)
        counts = {r.symbol: {k: r[k] for k in ("n_rows", "duplicates", "missing_days", "out_of_range", "inconsistent")} for r in quality.index_report(index).collect()}
        manifest["quality"] = {c: counts.get(c, {"n_rows": 0}) for c in parts}
        if known_day:
            found = quality.known_day_control(index.where(F.col("symbol") == known_day["symbol"]), known_day["day"], known_day.get("low_below"), known_day.get("high_above")).first()
            manifest["known_day"] = bool(found and found.ok)
        files.write_json(spark, path, manifest)
        return manifest


def read_index(spark: SparkSession, root: str, manifest: dict | None = None) -> DataFrame:
    """(ts, day, open, high, low, close, symbol) of the parts that the manifest names."""
    root = root.rstrip("/")
    manifest = manifest or files.read_json(spark, f"{root}/{MANIFEST}")
    schema = "ts timestamp, day date, open double, high double, low double, close double, symbol string"
    out = spark.createDataFrame([], schema)
    for run in sorted(set(manifest["parts"].values())):
        if files.exists(spark, f"{root}/{run}/index"):
            own = [c for c, r in manifest["parts"].items() if r == run]
            out = out.unionByName(spark.read.schema(schema).parquet(f"{root}/{run}/index").where(F.col("symbol").isin(own)))
    return out


def snapshot_digest(manifest: dict) -> str:
    """A digest of the files that a manifest's pairs come from, the same for whichever runs brought them in."""
    lines = sorted("|".join(e[k] or "" for k in (*KEYS, "sha256")) for e in manifest["files"])
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()
