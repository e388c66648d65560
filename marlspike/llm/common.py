"""What the operators share: written intermediate tables, and text as flat byte arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.sources.shared import new_path, remove

#: White space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"


#: Spark's own settings while a table is written: the shuffle files behind it go when it is, and no more than so many texts, a few MB,
#: are in one Arrow batch, which is outside of an executor's heap.
_CLEANUP, _BATCH, _BATCH_ROWS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


@contextmanager
def _sparing(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in (_CLEANUP, _BATCH)}
    rows = int(before[_BATCH] or 0)
    try:
        spark.conf.set(_CLEANUP, "true")
        spark.conf.set(_BATCH, str(min(rows, _BATCH_ROWS) if rows > 0 else _BATCH_ROWS))
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Files of a small table, for each core of the cluster.
FILES_A_CORE = 4


def written(df: DataFrame, label: str, few: bool = False) -> DataFrame:
    """df, written once to the shared folder as Parquet and read again: lineage ends here, a lost executor costs no recomputation,
    and the shuffles behind it are deleted at once.

    few: no texts go into the table or the stage before it, which has FILES_A_CORE tasks and files a core at most, whatever the number of shuffle partitions."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    with _sparing(spark):
        (df.coalesce(FILES_A_CORE * spark.sparkContext.defaultParallelism) if few else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def delete(*tables: DataFrame) -> None:
    """Remove tables that written() made and that no plan reads any more."""
    for df in tables:
        if path := getattr(df, "_written_path", None):
            remove(df.sparkSession, path)


#: A key with this part of a table's rows or more is joined by a broadcast; there are as many such keys at most.
HOT = 1000


def with_counts(rows: DataFrame, counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """rows joined with counts: one row for each of some keys, in n the number of its rows.

    Both are written tables, as each is read several times. Keys with a HOT-th of all rows or more, HOT keys at most, come to
    the driver; their counts are broadcast, so that their rows stay where they are. The others meet in a shuffle, in groups
    below that size. Each row is read by one of the two joins, and comes out of it once at most."""
    hot = F.col(n) * HOT >= rows.count()
    keys = [r[0] for r in counts.where(hot).select(key).collect()]
    if not keys:
        return rows.join(counts, key)
    of_hot = F.col(key).isin(keys)
    return rows.where(of_hot).join(F.broadcast(counts.where(hot)), key).unionByName(rows.where(~of_hot).join(counts.where(~hot), key))


_ROW_LOCAL = re.compile(r"(Project|Filter|FileScan|Scan parquet|ColumnarToRow|Union)\b")


def settled(docs: DataFrame, label: str) -> DataFrame:
    """docs such that each plan over it reads the same rows in the same order: docs itself where it is files, projected or filtered,
    and else a written copy. Row numbers made in several plans agree then."""
    plan = docs._jdf.queryExecution().sparkPlan().toString()
    nodes = [re.sub(r"^[\s:+|*-]*(\(\d+\) )?", "", line) for line in plan.splitlines() if line.strip()]
    deterministic = not re.search(r"\b(rand|randn|uuid|shuffle|random)\(", plan)
    return docs if deterministic and all(_ROW_LOCAL.match(n) for n in nodes) else written(docs, label)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents whose labels no model may see."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> pa.Table:
    """(text, y) of at most `limit` labelled rows outside the held-out fifth, the smallest by a hash of doc_id.

    Rows with a null doc_id or label don't count; a doc_id with several labels takes the largest."""
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    # At most `limit` ids of eight bytes: small by its parameter.
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return texts.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(limit).select("text", "y").toArrow()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; row i is bytes[offsets[i]:offsets[i+1]]. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offs, values = column.buffers()
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offs else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8) if values else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `limit` bytes of text each, so that arrays beside the text stay small. A row is never cut."""
    if not batch.num_rows:
        return
    sizes = np.diff(flat(batch.column(batch.schema.get_field_index(column)))[1])
    part = (np.cumsum(sizes) - sizes) // limit
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(sizes)], strict=True):
        yield batch.slice(a, b - a)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: uint64 in, well spread uint64 out."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_PLACE = mix64(np.arange(1000, 1256, dtype=np.uint64)) | np.uint64(1)


def words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray | None = None, kept: np.ndarray | None = None, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """(row, start, end, 64-bit hash) of each word: the longest runs of bytes that aren't white space, in order, none across rows.

    letters: the bytes to hash in place of the text's (say, lower-cased). kept: which of them count (default: all).
    stems: lengths in bytes; for each a further array, the hash of the word's beginning, 0 where the word isn't longer."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if not len(data):
        return none[0], none[0], none[0], none[1], *(none[1] for _ in stems)
    inside = ~_IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    edge = np.empty(len(data), bool)
    edge[0] = True
    np.logical_not(inside[:-1], out=edge[1:])
    start = np.flatnonzero(inside & (edge | first[:-1]))
    edge[-1] = True
    np.logical_not(inside[1:], out=edge[:-1])
    end = np.flatnonzero(inside & (edge | first[1:])) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    if not len(start):
        return row, start, end, none[1], *(none[1] for _ in stems)
    counted = inside if kept is None else inside & kept
    upto = np.cumsum(counted, dtype=np.int64) - counted
    place = upto[start[0] :] - np.repeat(upto[start], np.diff(start, append=len(data)))
    codes = _BYTE[(data if letters is None else letters)[start[0] :]] * (_PLACE[place & 255] + (place >> 8).astype(np.uint64))
    codes[~counted[start[0] :]] = 0
    whole = mix64(np.add.reduceat(codes, start - start[0]))
    if not stems:
        return row, start, end, whole
    size = upto[end - 1] + counted[end - 1] - upto[start]
    out = []
    for n in sorted(stems, reverse=True):
        codes[place >= n] = 0
        out.append(np.where(size > n, mix64(np.add.reduceat(codes, start - start[0]) + np.uint64(n)), 0))
    return row, start, end, whole, *out[::-1]


#: Byte classes of UTF-8 text.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes in lower case, where they were capitals): A to Z and the accented Latin-1 capitals, whose second byte is 0x80 to 0x9E after 0xC3."""
    low = _LOWER[data]
    accented = np.zeros(len(data), bool)
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low[accented] += 0x20
    return low, (low != data)


def sums(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How often mask holds in each range."""
    upto = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=upto[1:], dtype=np.int32)
    return (upto[end] - upto[start]).astype(np.float64)
