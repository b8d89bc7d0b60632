"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators.materialize import discard, materialize

MAX_ROUNDS = 100


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("u > v").groupBy("u", "v").agg(F.lit(1).alias("one")).select("u", "v")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(u, v)``; a component is its smallest node.

    Every round hangs each node's larger neighbours, then its smaller ones, under
    the smallest it sees; minima are aggregated before the shuffle and no
    neighbourhood is gathered into a row. Rounds grow with the logarithm of the
    number of nodes; each is written to the checkpoint folder. Edges that are
    null on a side or join a node to itself are no edges.
    """
    turned = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"),
                          (F.col("u").isNull() | F.col("v").isNull()).alias("open"))
    now = materialize(_distinct(turned.where("NOT open").select("u", "v")), "components")
    seen = _summary(now)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the minima are written, so that both sides of a join are plain exchanges: only
        # then does adaptive execution split the rows of a node with very many neighbours
        first = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m")), "minima")
        large = materialize(_distinct(both.join(first, "u").where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v"))), "components")
        second = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(second, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(_distinct(small.unionByName(second.select("u", F.col("m").alias("v")))),
                            "components")
        for written in (now, first, large, second):
            discard(written)
        now, before = after, seen
        seen = _summary(now)
        if seen == before:
            break
    else:
        raise RuntimeError("connected components did not settle")
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _summary(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"),
                    F.sum(F.xxhash64("v", "u") % 1000003).alias("s")).first()
    return row["n"], row["x"], row["s"]
