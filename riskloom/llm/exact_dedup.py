"""Exact dedup by distributed MSD radix partitioning.

Level r takes the next WIDTHS[r] bytes of every text that is still in a group with others as one digit. A digit that is
shorter than its width means that the text has ended. Rows and texts are never shuffled: the task that reads a file
groups its rows by (group, digit) first, and sends one row for each, with the digit, the rows' numbers, their count and
the row that would stay. So the copies of a hot text cost one digit a file and 8 bytes each. These rows are counted by
(group, digit) and learn their group's count by a join of plain exchanges, whose large partitions adaptive execution can
split (the groups grow with the corpus, so they are never broadcast). Rows of a new group go back beside their file; a row
alone in its group is finished, as is one whose text has ended: its group is then a class of equal texts. Only the others
go on, so unique documents are compared over their first bytes alone. Equality is decided by bytes, never by a digest; the
SHA-256 is an output. Digits grow to WIDEST bytes, so levels are few and no row is longer than that.

Defined results: null counts as the empty text; equal texts are those identical after lower-casing A-Z; of a class the
row with the largest doc_id stays (null is smallest; among rows repeated with that doc_id, exactly one stays). Empty
tables give empty results. Extra columns are ignored or carried, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import scratch

FIRST_WIDTH = 64
GROWTH = 8
WIDEST = 1 << 20
#: Bytes of distinct digits that a task holds before it sends them.
HELD = 1 << 25


def numbered(docs: DataFrame, keep: list[str], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(row, id, text, n_bytes, uid, file_no): the numbered table that the levels read."""
    text = F.col(text_column)
    return scratch.numbered(
        docs.select(F.struct(*keep).alias("row"), F.col(id_column).alias("id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).alias("n_bytes")), "radix-texts"
    )


def digits(texts: DataFrame, offset: int, width: int, path: str | None) -> DataFrame:
    """(file_no, gid, digit, uids, n, best): one row for each digit of a group in a file; ``path`` has the groups of rows."""
    of_id = texts.schema["id"].dataType.simpleString()

    def run(batches):
        side = scratch.Beside(path) if path else None
        held: dict[tuple[int, bytes], list] = {}
        size, at = 0, None

        def sent():
            keys = list(held)
            best = [held[k][1] for k in keys]
            arrays = [
                pa.array([at] * len(keys), pa.int32()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.binary()),
                pa.array([held[k][0] for k in keys], pa.list_(pa.int64())), pa.array([len(held[k][0]) for k in keys], pa.int64()),
                pa.StructArray.from_arrays([pa.array([b[1] for b in best], id_type), pa.array([b[2] for b in best], pa.int64())], ["id", "uid"]),
            ]
            return pa.RecordBatch.from_arrays(arrays, ["file_no", "gid", "digit", "uids", "n", "best"])

        for batch in batches:
            id_type = batch.schema.field("id").type
            numbers, uids = batch.column("file_no").to_numpy(), batch.column("uid").to_numpy()
            edges = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for low, high in zip(edges[:-1], edges[1:]):
                if high == low:
                    continue
                if at != int(numbers[low]) and held:
                    yield sent()
                    held, size = {}, 0
                at = int(numbers[low])
                some, own = range(low, high), uids[low:high]
                gids = [0] * len(own)
                if side:
                    columns, where = side.of(at, own)
                    some = [low + i for i, (a, b) in enumerate(where) if b > a]
                    gids = [int(columns["gid"][a]) for a, b in where if b > a]
                taken = batch.take(pa.array(some, pa.int64())) if side else batch.slice(low, high - low)
                for gid, cut, uid, name in zip(gids, taken.column("cut").to_pylist(), taken.column("uid").to_pylist(), taken.column("id").to_pylist()):
                    key, row = (gid, cut.lower()), (name is not None, name, uid)
                    if (found := held.get(key)) is None:
                        held[key] = [[uid], row]
                        size += len(cut) + 64
                    else:
                        found[0].append(uid)
                        if row[0] and (not found[1][0] or row[1:] > found[1][1:]) or not row[0] and not found[1][0] and uid > found[1][2]:
                            found[1] = row
                if size > HELD:
                    yield sent()
                    held, size = {}, 0
        if held:
            yield sent()

    cut = F.substring(F.coalesce("text", F.lit("")).cast("binary"), offset + 1, width).alias("cut")
    rows = texts.where(F.col("n_bytes") >= offset).select("uid", "file_no", "id", cut)
    return rows.mapInArrow(run, f"file_no int, gid long, digit binary, uids array<long>, n long, best struct<id:{of_id},uid:long>")


def repeated(texts: DataFrame) -> str:
    """Beside the files of a :func:`numbered` table: (uid, n, keep_id, kept) of every row of a class of two or more."""
    spark = texts.sparkSession
    with scratch.scope(spark) as scope:
        parts, path, offset, width = [], None, 0, FIRST_WIDTH
        while True:
            found = scratch.stage(digits(texts, offset, width, path), f"radix-digits-{offset}")
            groups = found.groupBy("gid", "digit").agg(F.sum("n").alias("total"), F.max("best").alias("stays")).where("total > 1")
            groups = scratch.stage(groups.withColumn("next", F.monotonically_increasing_id()), f"radix-groups-{offset}")
            ended = F.length("digit") < width
            joined = found.join(groups.hint("merge"), ["gid", "digit"]).select("file_no", "uids", "next", "total", "stays", ended.alias("ended"))
            level = scratch.stage(joined, f"radix-level-{offset}")
            parts.append(level.where("ended").select("file_no", F.explode("uids").alias("uid"), F.col("total").alias("n"), "stays"))
            active = level.where("not ended").select("file_no", F.explode("uids").alias("uid"), F.col("next").alias("gid"))
            if active.isEmpty():
                break
            path = scratch.beside(active, f"radix-active-{offset}")
            offset, width = offset + width, min(width * GROWTH, WIDEST)
        done = reduce(DataFrame.unionByName, parts).select("file_no", "uid", "n", F.col("stays.id").alias("keep_id"), (F.col("uid") == F.col("stays.uid")).alias("kept"))
        return scratch.beside(done, "radix-classes", scope.place("radix-classes"))


def classes(docs: DataFrame, keep: list[str], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The columns ``keep`` of each row as struct ``row``, and ``keep_id, group_size, kept, text_sha256`` (of the lower-cased text)."""
    texts = numbered(docs, keep, id_column, text_column)
    path = repeated(texts)

    def run(batches):
        side = scratch.Beside(path)
        for file_no, batch in scratch.text_slices(batches, 64 << 20):
            at, table = side.rows(file_no, batch.column("uid").to_numpy())
            of = lambda name, single: pc.if_else(at.is_valid(), table.column(name).combine_chunks().take(at), single) if table is not None else single  # noqa: B023, E731
            one = pa.array(np.ones(batch.num_rows, np.int64))
            sha = [hashlib.sha256((x.as_py() or "").encode("utf-8", "surrogatepass").lower()).hexdigest() for x in batch.column("text")]
            columns = [batch.column("row"), of("keep_id", batch.column("id")), of("n", one), of("kept", pa.array([True] * batch.num_rows)), pa.array(sha)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "keep_id", "group_size", "kept", "text_sha256"])

    row, of_id = (texts.schema[c].dataType.simpleString() for c in ("row", "id"))
    out = texts.select("row", "id", "text", "uid", "file_no")
    return out.mapInArrow(run, f"row {row}, keep_id {of_id}, group_size long, kept boolean, text_sha256 string")


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each class of equal texts, all columns as they were."""
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    texts = numbered(whole, ["doc"])
    path = repeated(texts)

    def run(batches):
        side = scratch.Beside(path)
        for file_no, batch in scratch.text_slices(batches, 64 << 20):
            at, table = side.rows(file_no, batch.column("uid").to_numpy())
            stays = pc.fill_null(table.column("kept").combine_chunks().take(at), True) if table is not None else pa.array([True] * batch.num_rows)
            yield batch.select(["row"]).filter(stays)

    return texts.select("row", "text", "uid", "file_no").mapInArrow(run, texts.select("row").schema).select("row.doc.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classes(docs, ["doc_id"]).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


#: The same classes by plain grouping.
OP6_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
