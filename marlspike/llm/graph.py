"""Connected components of a written table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspike.llm.common import delete, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for every id of a link but the roots themselves; root is the smallest id of the component.

    Links of an id with itself and nulls are ignored. A node's links are never gathered: its smallest neighbour is a map-side
    combined minimum, and goes back by a join. Each round is written, and one number of it comes to the driver."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = written(edges, "cc", few=True)
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, written(small, "cc", few=True)
        delete(before)
        last, state = state, _state(edges)
        if state == last:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
