"""Connected components by alternating large and small stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

MAX_ROUNDS = 60


def _pairs(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """Edges (u > v) once each, written, with a fingerprint of the set."""
    edges = stored(edges.where("u <> v").groupBy("u", "v").agg(F.lit(1).alias("n")).drop("n"), name)
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(xxhash64(v, u) % 1000003)")).first()
    return edges, tuple(row)


def components(links: DataFrame, one: str, other: str) -> DataFrame:
    """(id, component) of every linked id; the component is its smallest id.

    A star's centre may be linked to a third of all ids: its neighbours are reduced to their
    minimum map-side, and joined back by a join that can be split. No neighbourhood is collected.
    """
    a, b = F.col(one).cast("long"), F.col(other).cast("long")
    edges, mark = _pairs(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), "component-links")
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "component-least")
        # Large star: neighbours greater than u are linked to the least of u's neighbourhood.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, _ = _pairs(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "component-large")
        # Small star: u and its lesser neighbours are linked to the least of them.
        least = stored(edges.groupBy("u").agg(F.min("v").alias("m")), "component-least")
        small = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        edges, new = _pairs(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "component-small")
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    # Every edge now leads to the least id of its component.
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
