"""Connected components of a graph of links, by alternating large and small stars.

Each round hangs every node's larger neighbours on the smallest one it sees, then its smaller ones; both are joins and
minimum aggregations, and the rounds needed grow with the logarithm of the longest path.  Each round is written to the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import discard, materialize


def _least(pairs: DataFrame) -> DataFrame:
    """x and its smallest y. The key is computed anew, so that it is shuffled anew in a join, where both sides of a plain
    shuffle can be split if one node has very many neighbours. Merged: rounds are many, and a broadcast for each join of
    each would pile up in the driver."""
    return pairs.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").bitwiseOR(F.lit(0)).alias("x"), F.least("x", "m").alias("m")).hint("merge")


def _each(rows: DataFrame, *pairs: tuple[Column, Column], names: tuple[str, str]) -> DataFrame:
    """Every row gives all the pairs. Exploded and not united, so that a plan has what the rows come from once."""
    x, y = names
    both = F.array(*[F.struct(p.alias(x), q.alias(y)) for p, q in pairs])
    return rows.select(F.explode(both).alias("p")).select(f"p.{x}", f"p.{y}")


def _round(edges: DataFrame) -> DataFrame:
    both = _each(edges, (F.col("a"), F.col("b")), (F.col("b"), F.col("a")), names=("x", "y"))
    large = both.join(_least(both), "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
    small = large.join(_least(large), "x")
    hung = _each(small, (F.least("y", "m"), F.greatest("y", "m")), (F.least("x", "m"), F.greatest("x", "m")), names=("a", "b"))
    return hung.filter("a < b").distinct()


def components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """links (a, b) to (node, component): the smallest node reachable. Nodes without links have no row. Some twice the
    logarithm of the longest path are needed; a graph that isn't at rest after ``rounds`` is an error, never a result."""
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    edges, before = materialize(edges, "edges"), None
    for _ in range(rounds):
        new = materialize(_round(edges), "edges")
        discard(edges)
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        edges = new
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"components are not at rest after {rounds} rounds")
    # At rest every node hangs on its component's smallest.
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
