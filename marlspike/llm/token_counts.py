"""Token counts by a separator scan over flat token files.

A flat token file holds token ids of fixed width, one document after the other, each ended by a separator id; it has no
index. The scan cuts the files into blocks, reads each block as one array and searches it for separators at once. A block
yields the counts of the documents that end in it, but for the first, which may have begun blocks before; a prefix maximum
of the blocks' last separators, and a prefix sum of their numbers, give that document's beginning and every document's
ordinal.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlspike.llm.common import new_path, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: An id that the vocabulary leaves free.
SEPARATOR = 50256
#: Ids are little-endian and so many bytes wide.
WIDTH = 2
BLOCK_TOKENS = 1 << 20


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a path without a scheme, or with file:, is local."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def write_token_files(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, separator: int = SEPARATOR) -> DataFrame:
    """Tokenise docs into flat files in a shared folder, one for each task; returns (file, ordinal, key) of every row.

    A null or empty text is a separator alone. Special tokens' names in a text are ordinary text. A task that is run again
    writes a file of its own, and only the file of the run that Spark took is in the result, which is written at once."""
    import public_tokenizers
    import tiktoken

    with open(tokenizer, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        file = f"{folder}/{uuid.uuid4().hex}.tok"
        system, path = _at(file)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        ordinal = 0
        with system.open_output_stream(path) as out:
            for batch in batches:
                for t in batch.column(1).to_pylist():
                    ids = coder.encode_ordinary(t) if t else []
                    ids.append(separator)
                    out.write(np.array(ids, "<u2").tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(np.arange(ordinal, ordinal + n)), batch.column(0)], ["file", "ordinal", "key"])
                ordinal += n

    kind = docs.schema[key].dataType.simpleString()
    return written(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"file string, ordinal long, key {kind}"), "token-index")


def scan_token_files(files: DataFrame, separator: int = SEPARATOR, width: int = WIDTH, block: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, n_tokens) of every document of the flat files named in column `file`; separators don't count.

    Tokens after a file's last separator are a document without an end, and come as its last row with ended false."""
    kind = np.dtype(f"<u{width}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, path = _at(file)
                n = system.get_file_info(path).size // width
                begin = np.arange(0, n, block, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(begin), pa.string()), pa.array(begin), pa.array(np.minimum(block, n - begin))], ["file", "begin", "n"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, begin, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                system, path = _at(file)
                with system.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(n * width, begin * width), kind)
                at = np.flatnonzero(ids == separator)
                first, last = (begin + int(at[0]), begin + int(at[-1])) if len(at) else (None, None)
                row = [file, begin, n, first, last, (np.diff(at) - 1).tolist(), len(at)]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

    names = ["file", "begin", "n", "first", "last", "inner", "ends"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
    spark = files.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    blocks = files.select("file").where("file IS NOT NULL").distinct().mapInArrow(cut, "file string, begin long, n long").repartition(tasks, "file", "begin")
    blocks = blocks.mapInArrow(scan, "file string, begin long, n long, first long, last long, inner array<long>, ends long")
    blocks = written(blocks, "token-blocks", few=True)
    # the scan over a file's blocks moves a few numbers of each, and not their counts
    before = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file")
    slim = blocks.select("file", "begin", "n", "last", "ends")
    slim = slim.withColumns({"base": F.coalesce(F.sum("ends").over(before), F.lit(0)), "previous": F.coalesce(F.max("last").over(before), F.lit(-1)), "end": F.max(F.col("begin") + F.col("n")).over(upto), "final": F.max("last").over(upto), "all": F.sum("ends").over(upto)})
    slim = slim.drop("n", "last", "ends")
    stitched = slim.join(blocks, ["file", "begin"])
    counts = F.concat(F.array(F.col("first") - F.col("previous") - 1), "inner")
    ended = stitched.where("ends > 0").select("file", "base", F.posexplode(counts).alias("i", "n_tokens"))
    ended = ended.select("file", (F.col("base") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    rest = F.col("end") - F.coalesce("final", F.lit(-1)) - 1
    open_ = slim.where("begin = 0").where(rest > 0).select("file", F.col("all").alias("ordinal"), rest.alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(open_)


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per row of docs: key, n_tokens. Null and empty texts have 0; repeated rows each their own; long texts are tokenised
    whole, one at a time in memory; other columns don't matter and may have any names. An empty table gives no rows."""
    folder = new_path(docs.sparkSession, "token-files")
    index = write_token_files(docs, folder, key, text, tokenizer)
    counted = scan_token_files(index.select("file")).where("ended").select("file", "ordinal", "n_tokens")
    # both sides have a row for each document; the index packs so well that its files would pass for a small table
    return index.hint("merge").join(counted, ["file", "ordinal"]).select(F.col("key").alias(key), "n_tokens")
