"""Connected components of an edge table by repeated hooking and contraction."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Map each node of ``edges`` (a, b; any type with an order) to a root: rows (node, root), one per node.

    Every round hooks each node to the neighbour (or itself) that comes first in a hash order of that round, halves the
    hook chains, and contracts the edges; every edge's later end hooks, so the nodes with edges get fewer in each
    round, by a constant factor on average. Only aggregates and equi-joins are used, so a node with very many edges is no
    single task's list. Self-loops, repeated edges and nulls are dropped. Each round's edges are written to the shared
    folder, its hooks held on the executors' disks; the result is a table that belongs to ``scratch``, if given.
    """
    with Scratch(edges.sparkSession, scratch) as own:
        edges = own.write(edges.where("a is not null and b is not null and a != b").select("a", "b").distinct(), "edges")
        rounds = []
        for round_no in count():
            if edges.isEmpty():
                break
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(round_no)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
            hooks = both.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", order("a"))["v"].alias("root"))
            hooks = own.hold(hooks)
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            hooks = hooks.join(up, "root").select("node", F.col("next").alias("root"))
            left, right = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra")), hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
            edges = own.write(edges.join(left, "a").join(right, "b").where("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
            rounds.append(hooks)
        if not rounds:
            return own.keep(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "components")
        mapping = rounds[0]
        for hooks in rounds[1:]:
            step = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            mapping = mapping.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        return own.keep(mapping, "components")
