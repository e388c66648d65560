"""Exact duplicates by most-significant-digit radix partitioning.

Documents are split by successive bytes. A round reads the next block of bytes of each open document, and splits each
group by that block; a group of one document is done, and so is a group whose documents have ended. What is left goes to
the next round, with a block `growth` times as wide, so that a text of n bytes takes about log(n) rounds, and most
documents leave in the first. Equality is of the bytes themselves: no digest decides.

A round is one map-side combined count by (group, block) and one join with the groups that have several documents. The
join carries a hot group's documents in as many tasks as adaptive execution splits them into; no task gathers a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.llm.common import SPACE, delete, written

FIRST_BYTES = 64
GROWTH = 64


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] = (), first: int = FIRST_BYTES, growth: int = GROWTH) -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256, and in `row` the columns of `carry`.

    Of equal texts (white-space runs count as one space, null as empty) the row with the smallest key stays; a null key
    comes last; of repeated rows with one key exactly one stays. Other columns don't matter and may have any names. An
    empty table gives no rows. docs must read the same rows in the same order each time, as a table of files does."""
    body = F.encode(normalised(F.col(text)), "UTF-8")
    order = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.monotonically_increasing_id().alias("r"))
    row = [F.struct(*[docs[c] for c in carry]).alias("row")] if carry else []
    state = docs.select(order.alias("at"), body.alias("rest"), *row).select("at", "rest", F.lit(0).cast("long").alias("gid"), F.sha2("rest", 256).alias("sha"), *["row"] * bool(carry))
    width, done, before = first, [], None
    while True:
        cut = state.withColumns({"block": F.substring("rest", 1, width), "ended": F.length("rest") <= width})
        groups = (
            cut.groupBy("gid", "block", "ended")
            .agg(F.count("*").alias("size"), F.min("at").alias("keep"))
            .where("size > 1")
            .withColumn("next", F.monotonically_increasing_id())
        )
        groups = written(groups, "radix-groups")  # fixes the numbers of the groups
        # sorted and merged at every size: a plan that changes with the size of the groups can't be measured on a small input
        split = cut.hint("merge").join(groups, ["gid", "block", "ended"], "left")
        resolved = F.col("size").isNull() | F.col("ended")
        rest = F.when(~resolved, F.substring(F.col("rest"), width + 1, 2**31 - 1))
        table = written(
            split.select("at", "sha", F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("keep", "at").alias("keep"), "next", rest.alias("rest"), *["row"] * bool(carry)),
            "radix",
        )
        delete(groups)
        done.append(table.where("rest IS NULL"))
        state = table.where("rest IS NOT NULL").select("at", "rest", F.col("next").alias("gid"), "sha", *["row"] * bool(carry))
        if state.isEmpty():
            break
        width *= growth
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(
        F.col("at.k").alias(key),
        F.col("keep.k").alias("keep_id"),
        F.col("size").cast("long").alias("group_size"),
        (F.col("at") == F.col("keep")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *["row"] * bool(carry),
    )


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the copies: the columns of docs, for the rows that stay."""
    return exact_groups(docs, key, text, docs.columns).where("kept").select("row.*")
