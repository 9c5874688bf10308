"""Small files beside the tables: texts and JSON replaced in one step, directory locks, YAML settings."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

try:
    import yaml
except ModuleNotFoundError:  # an optional package
    yaml = None

LOCK = "_lock"


class Busy(RuntimeError):
    """Another run holds the directory."""


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """Replaces a file by ``text`` and returns its SHA-256; readers see the old file or the new one, never a part.

    The rename is one step on HDFS and mounted folders; object stores replace by copy, whole as well.
    """
    jvm, blob = spark._jvm, text.encode()
    fs, staging = _file_system(spark, path + ".staging")
    out = fs.create(staging, True)
    try:
        out.write(bytearray(blob))
        out.hsync()
    finally:
        out.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(staging), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(path)), how)
    return hashlib.sha256(blob).hexdigest()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_json(spark: SparkSession, path: str, value) -> str:
    """One JSON document with sorted keys; returns the SHA-256 of its text."""
    return write_text(spark, path, json.dumps(value, indent=1, ensure_ascii=False, sort_keys=True) + "\n")


def read_json(spark: SparkSession, path: str):
    return json.loads(read_text(spark, path))


def write_outcome(results: DataFrame, path: str) -> None:
    """Rows of a result as JSON lines, undefined fields written as nulls."""
    results.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


@contextmanager
def locked(spark: SparkSession, directory: str, owner: str) -> Iterator[None]:
    """Holds a directory while a run lasts; a directory that another run holds is an error, not a wait.

    The lock is a file whose creation fails if it is there (one step on HDFS; on local disks check and creation are two). A
    second file names the owner. What a killed run leaves is removed by hand.
    """
    path = f"{directory.rstrip('/')}/{LOCK}"
    fs, where = _file_system(spark, path)
    if not fs.createNewFile(where):
        raise Busy(f"{path} is held")
    try:
        write_text(spark, path + "-owner", owner)
        yield
    finally:
        fs.delete(_file_system(spark, path + "-owner")[1], False)
        fs.delete(where, False)


# ---------------------------------------------------------------- settings


def _without_repeats():
    class Loader(yaml.SafeLoader):
        def construct_mapping(self, node, deep=False):
            keys = [self.construct_object(k, deep=deep) for k, _ in node.value]
            if len(set(keys)) < len(keys):
                raise ValueError(f"repeated keys among {keys}")
            return super().construct_mapping(node, deep)

    return Loader


def read_settings(path: str | Path) -> dict:
    """A YAML map from the driver's disk; a key given twice is an error."""
    if yaml is None:
        raise ModuleNotFoundError("reading settings needs PyYAML")
    found = yaml.load(Path(path).read_text(encoding="utf-8"), _without_repeats())
    if not isinstance(found, dict):
        raise ValueError("settings are a map")
    return found


def setting(settings: dict, *keys: str):
    """The value under nested keys; a missing one is an error that names it."""
    for depth, key in enumerate(keys, 1):
        if not isinstance(settings, dict) or key not in settings:
            raise KeyError(".".join(keys[:depth]))
        settings = settings[key]
    return settings


def feature_problems(entries: dict[str, dict], known: dict) -> list[str]:
    """What keeps registered features out of models: unknown builders, other delays than the builder's, missing fields,
    and two names for one variant (same source, formula and delay, but for spaces and case)."""
    problems, variants = [], {}
    for name, entry in sorted(entries.items()):
        absent = sorted({"source", "formula", "delay_days"} - set(entry))
        if absent:
            problems.append(f"{name}: no {', '.join(absent)}")
            continue
        if name not in known:
            problems.append(f"{name}: no builder")
        elif (known[name].source, known[name].delay_days) != (entry["source"], entry["delay_days"]):
            problems.append(f"{name}: differs from its builder")
        variant = "".join(f"{entry['source']}|{entry['formula']}|{entry['delay_days']}".split()).lower()
        if (first := variants.setdefault(variant, name)) != name:
            problems.append(f"{name}: same variant as {first}")
    return problems
