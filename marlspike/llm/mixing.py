"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a keyed digest. A document's virtual finish time is the number of its source's
tokens up to and with it, divided by the source's target. Documents of all sources, and the repeats that a source needs
to reach its target, are sorted by finish time over the whole cluster, and the queue is cut where it reaches the budget.

Running sums never gather a source in one task. Within a source, the shuffled order is cut into bins of about ROWS_A_BIN
rows by the digest's leading bits; bins are summed first, by shelves of bins, then documents within a bin. The queue is range-partitioned; only
the partition in which the budget ends is summed row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspike.llm.common import SPACE, written

#: A source's target is at most so many times its size, and a document is repeated at most so often.
MAX_REPEATS = 3
ROWS_A_BIN = 1_000
BINS_A_SHELF = 1_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of other than white space. Nulls have none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """From (source, source_size) the columns rank, weight and target: the sizes' sum, shared by weight, no source above its cap.

    Resharing what is above a cap, until none is, ends at min(cap, level x weight) with one level; the capped sources are
    those with the smallest cap by weight. One row per source: metadata, not data."""
    by_name = Window.partitionBy("one").orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("one", F.lit(1)).withColumn("rank", F.row_number().over(by_name)).withColumn("weight", (F.col("rank") - 1) % 3 + 1)
    ranked = ranked.withColumn("cap", F.col("source_size") * max_repeats).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.partitionBy("one").orderBy("ratio", "rank")
    everything, earlier = Window.partitionBy("one"), by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    levels = ranked.withColumn("level", left.cast("double") / weights.cast("double"))
    # the level is the first one, in order of ratio, that the next source's cap is not below
    levels = levels.withColumn("fits", F.col("level") <= F.col("ratio"))
    level = F.min(F.when(F.col("fits"), F.struct("ratio", "rank", "level"))).over(everything)
    levels = levels.withColumn("first", level)
    under = F.struct("ratio", "rank") < F.struct(F.col("first.ratio"), F.col("first.rank"))
    target = F.when(F.col("first").isNull() | under, F.col("cap").cast("double")).otherwise(F.col("first.level") * F.col("weight"))
    return levels.select("source", "source_size", "rank", "weight", target.alias("target"))


def mix_queue(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", max_repeats: int = MAX_REPEATS, partitions: int | None = None) -> DataFrame:
    """The queue: one row per row of docs and repeat, with its finish time, and `in`: whether it comes before the cut.

    Columns: r (number of the row), k (its key), h, epoch, size, source, source_size, rank, target, finish, in. A null text has size 0, a null source is a source of its own and comes last, a null key counts as the empty key.
    Repeated rows are documents of their own, with one place in the shuffle; ties end by size. An empty table gives no rows."""
    spark = docs.sparkSession
    base = docs.select(F.col(key).alias("k"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col("k").cast("string")))
    base = base.withColumns({"h": F.conv(F.substring(digest, 1, 14), 16, 10).cast("long"), "r": F.monotonically_increasing_id()})
    base = written(base, "mix-sizes")
    targets = written(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), max_repeats), "mix-targets", few=True)
    bins = max(1, base.count() // ROWS_A_BIN)
    sized = base.withColumn("bin", F.floor(F.col("h") / F.lit(2.0**56 / bins)).cast("int"))
    known = targets.select(F.col("source").alias("s"), "source_size", "rank", "target")
    sized = sized.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # running sums of bins within a shelf of BINS_A_SHELF, and of shelves within a source
    offsets = sized.groupBy("rank", "bin").agg(F.sum("size").alias("bin_size")).withColumn("shelf", F.floor(F.col("bin") / BINS_A_SHELF))
    before = Window.partitionBy("rank").orderBy("shelf").rowsBetween(Window.unboundedPreceding, -1)
    shelves = offsets.groupBy("rank", "shelf").agg(F.sum("bin_size").alias("shelf_size"))
    shelves = shelves.select("rank", "shelf", F.coalesce(F.sum("shelf_size").over(before), F.lit(0)).alias("below"))
    before = Window.partitionBy("rank", "shelf").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.withColumn("offset", F.coalesce(F.sum("bin_size").over(before), F.lit(0))).join(shelves, ["rank", "shelf"])
    offsets = offsets.select("rank", "bin", (F.col("offset") + F.col("below")).alias("offset"))
    inside = Window.partitionBy("rank", "bin").orderBy("h", "k", "size", "r").rowsBetween(Window.unboundedPreceding, 0)
    queue = sized.withColumn("within", F.sum("size").over(inside)).join(offsets, ["rank", "bin"])
    passes = F.ceil(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    passes = F.greatest(F.lit(1), F.least(F.lit(max_repeats), passes)).cast("int")
    finish = (F.col("epoch") * F.col("source_size") + F.col("offset") + F.col("within")).cast("double") / F.col("target")
    timed = queue.withColumn("epoch", F.explode(F.sequence(F.lit(0), passes - 1)))
    timed = timed.withColumn("finish", F.when(F.col("target") > 0, finish).otherwise(F.lit(0.0)))
    order = ["finish", "rank", "h", "k", "size", "r", "epoch"]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = timed.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    ranged = written(ranged.select("source", "source_size", "target", "part", *order), "mix-queue")
    parts = ranged.groupBy("part").agg(F.sum("size").alias("part_size")).withColumn("one", F.lit(1))  # a row per partition
    earlier = Window.partitionBy("one").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("begin", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)))
    parts = parts.crossJoin(F.broadcast(targets.agg(F.sum("source_size").alias("budget"))))  # a single row
    parts = parts.withColumn("whole", F.col("begin") + F.col("part_size") <= F.col("budget"))
    placed = ranged.join(F.broadcast(parts.drop("one", "part_size")), "part")
    running = F.sum("size").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    split = ~F.col("whole") & (F.col("begin") < F.col("budget"))  # of one partition only
    cut = placed.where(split).withColumn("in", F.col("begin") + running <= F.col("budget"))
    return placed.where(~split).withColumn("in", F.col("whole")).unionByName(cut).drop("begin", "budget", "whole", "part")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """One row per row of docs: key, size, source, source_size, target, taken (tokens that the mix takes, repeats counted).
    Texts of any length are counted whole; other columns don't matter and may have any names.

    See mix_queue(), whose options are options here too."""
    queue = mix_queue(docs, key, text, source, **options)
    per_row = queue.groupBy("r").agg(
        *[F.first(c).alias(c) for c in ("k", "size", "source", "source_size", "target")],
        F.sum(F.when(F.col("in"), F.col("size")).otherwise(0)).alias("taken"),
    )
    return per_row.select(F.col("k").alias(key), "size", "source", "source_size", "target", "taken")
