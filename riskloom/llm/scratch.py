"""Intermediate tables in the folder that the whole cluster shares.

Stages that several later plans read, and every iteration of an iterative operator, are written there and read
back: a lost executor then costs a re-read, not a recomputation of the lineage, and values that are assigned once
(row numbers) never change afterwards.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_DEFAULT = "file:///tmp/checkpoints"


def root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``; a default of our own only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_DEFAULT


_scopes: ContextVar[tuple[Scope, ...]] = ContextVar("scopes", default=())


class Scope:
    """The paths made inside one :func:`scope` block."""

    def __init__(self, spark: SparkSession, outer: tuple[Scope, ...]):
        self.spark, self.outer, self.paths = spark, outer, []

    def place(self, name: str) -> str:
        """A new path of the enclosing scope: it stays when this one ends."""
        token = _scopes.set(self.outer)
        try:
            return folder(self.spark, name)
        finally:
            _scopes.reset(token)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as a table of the enclosing scope."""
        return stage(df, name, self.place(name))

    def release(self) -> None:
        """Delete what was written inside: nothing that is still to be evaluated may read it."""
        while self.paths:
            remove(self.spark, self.paths.pop())


@contextmanager
def scope(spark: SparkSession, keep: bool = False):
    """Tables made inside go when the block ends; evaluate what reads them before, or write it by ``result``.

    Around a query, it frees what the query keeps in the shared folder; each block has its own list, so overlapping runs
    leave each other's tables alone. With ``keep`` they stay until ``release`` is called.
    """
    own = Scope(spark, _scopes.get())
    token = _scopes.set((*own.outer, own))
    try:
        yield own
    finally:
        _scopes.reset(token)
        if not keep:
            own.release()


_MARK = "riskloom.scope"
_marked: dict[str, Scope] = {}


def marked(df: DataFrame, own: Scope, column: str) -> DataFrame:
    """``df`` whose column's metadata names a scope; Parquet keeps it, so a table read back tells whose result it is."""
    name = uuid.uuid4().hex
    _marked[name] = own
    return df.withMetadata(column, {**df.schema[column].metadata, _MARK: name})


def release_behind(df: DataFrame, column: str) -> None:
    """Release the scope that ``df``, a table that was written from its result, is marked with. A frame that still reads
    from the scope itself leaves it alone."""
    name = df.schema[column].metadata.get(_MARK) if column in df.columns else None
    own = _marked.get(name)
    if own is not None and not any(path.rsplit("/", 1)[1] in leaf for leaf in _places(df) for path in own.paths):
        del _marked[name]
        own.release()


def _places(df: DataFrame) -> list[str]:
    """The folders that a frame's plan reads, as text."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return [leaves.apply(i).toString() + _paths_of(leaves.apply(i)) for i in range(leaves.size())]


def _paths_of(leaf) -> str:
    try:
        return leaf.relation().location().rootPaths().mkString(" ")
    except Exception:  # no relation over files  # noqa: BLE001
        return ""




def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{root(spark)}/riskloom/{name}-{uuid.uuid4().hex}"
    if _scopes.get():
        _scopes.get()[-1].paths.append(path)
    return path


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once, to a new path unless one is given, and return the written table."""
    spark = df.sparkSession
    path = path or folder(spark, name)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` written with a unique ``uid`` for each row and the number of the writing task as ``file_no``.

    Extra columns keep their names; ``uid`` and ``file_no`` must be free (callers pass only columns of their own).
    """
    return stage(df.withColumn("uid", F.monotonically_increasing_id()).withColumn("file_no", F.spark_partition_id()), name)


def beside(rows: DataFrame, name: str, path: str | None = None) -> str:
    """Write rows that belong to texts of a :func:`numbered` table, by ``file_no`` and sorted by ``uid``.

    Tasks over the texts then read their own rows with :class:`Beside`: no text is shuffled, nothing is broadcast.
    """
    path = path or folder(rows.sparkSession, name)
    rows.repartition("file_no").sortWithinPartitions("file_no", "uid").write.partitionBy("file_no").option("compression", "zstd").parquet(path)
    return path


class Beside:
    """Rows that :func:`beside` wrote, looked up by file and row number inside a task; one file's rows are held."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.system, self.place = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
        self.file_no = None

    def _open(self, file_no: int) -> None:
        import numpy as np
        import pyarrow.dataset as ds
        from pyarrow import fs

        if file_no != self.file_no:
            place = f"{self.place}/file_no={file_no}"
            found = self.system.get_file_info(place).type == fs.FileType.Directory
            self.table = ds.dataset(place, filesystem=self.system, format="parquet").to_table().sort_by("uid") if found else None
            self.uid = self.table.column("uid").to_numpy() if found else np.zeros(0, np.int64)
            self.columns, self.file_no = None, file_no

    def file(self, file_no: int):
        """The file's table, or None without rows."""
        self._open(file_no)
        return self.table

    def of(self, file_no: int, uids) -> tuple[dict, list[tuple[int, int]]]:
        """(columns as arrays, slice of them for each uid)."""
        import numpy as np

        self._open(file_no)
        if self.columns is None:
            self.columns = {c: self.table.column(c).to_numpy(zero_copy_only=False) for c in self.table.column_names} if self.table is not None else {"uid": self.uid}
        low, high = (np.searchsorted(self.uid, uids, side) for side in ("left", "right"))
        return self.columns, list(zip(low.tolist(), high.tolist()))

    def rows(self, file_no: int, uids):
        """(the place of each uid's one row, null without one; the file's table or None)."""
        import numpy as np
        import pyarrow as pa

        self._open(file_no)
        if self.table is None:
            return pa.nulls(len(uids), pa.int64()), None
        at = np.searchsorted(self.uid, uids)
        return pa.array(at, pa.int64(), mask=self.uid[np.minimum(at, len(self.uid) - 1)] != uids), self.table


def text_slices(batches, limit: int):
    """(file_no, record batch) parts of batches of a :func:`numbered` table, each of one file and about ``limit`` bytes."""
    import numpy as np

    from riskloom.llm import kernels

    for whole in batches:
        number = whole.column("file_no").to_numpy()
        edges = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), whole.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            if b > a:
                for part in kernels.slices(whole.slice(a, b - a), "text", limit):
                    yield int(number[a]), part
