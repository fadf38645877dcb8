"""Connected components of a graph that is only ever held as a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.shared import shared_folder
from fleetscope.operators.ordered import FEW_SALTS, join_groups
from fleetscope.session import Workspace


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Links each neighbour of a node to the smallest node around it."""
    if larger_only:
        pairs = edges.select(F.col("u"), F.col("v"))
    else:
        pairs = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = join_groups(pairs, least, ["u"], F.col("v"), FEW_SALTS)
    if larger_only:
        linked = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        linked = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return linked.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node with an edge to another; a component is named by its
    smallest node. Alternates large and small stars until nothing changes, a few rounds as a rule;
    each round's edges are kept in the shared folder until those of the next are.

    Edges with a null end and edges of a node to itself are left out; repeated edges count once.
    """
    kept = Workspace(edges.sparkSession, shared_folder(edges.sparkSession))
    now = kept.table(
        "0",
        edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
        .filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
    )
    mark, turn = None, 0
    while True:
        state = now.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark or not state[0]:
            break
        mark = state
        now, turn = kept.table(f"{turn + 1}", _star(_star(now, False), True)), turn + 1
        kept.drop(f"{turn - 1}")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
