"""Connected components by contraction: hook every node to its smallest neighbour, follow the hooks
to their roots, merge, and repeat on what is left of the graph. Nothing is collected; each round is
written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) for every node of an edge; the root is the smallest node of its component.

    Edges may repeat, run in either direction, or join a node to itself; null ends are ignored.
    """
    scratch = Scratch(edges.sparkSession)
    left = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a is not null and b is not null")
    left = scratch.write(left.filter("a < b").distinct(), "edges-0")
    nodes = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = scratch.write(nodes.select("node", F.col("node").alias("root")), "roots-0")
    turn = 0
    while not left.isEmpty():
        turn += 1
        # Every node hooks to its smallest neighbour, if smaller; hooks cannot form a cycle.
        hooks = left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        hooks = scratch.write(hooks, f"hooks-{turn}-0")
        jump = 0
        while True:
            jump += 1
            further = hooks.join(hooks.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left")
            moved = scratch.write(further.select("node", F.coalesce("next", "to").alias("to"),
                                                 F.col("next").isNotNull().alias("moved")), f"hooks-{turn}-{jump}")
            hooks = moved.select("node", "to")
            if moved.filter("moved").isEmpty():
                break
        step = hooks.withColumnRenamed("node", "root")
        roots = scratch.write(roots.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")),
                              f"roots-{turn}")
        ends = left.join(hooks.select(F.col("node").alias("a"), F.col("to").alias("ra")), "a", "left").join(
            hooks.select(F.col("node").alias("b"), F.col("to").alias("rb")), "b", "left")
        ends = ends.select(F.coalesce("ra", "a").alias("p"), F.coalesce("rb", "b").alias("q")).filter("p <> q")
        left = scratch.write(ends.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(),
                             f"edges-{turn}")
    return roots
