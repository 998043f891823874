"""Connected components of an edge table."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation, functions as F

from screenloom.session import durable

#: Nodes that a task keeps before it hands its forest on, and edges dealt to one task after the first round.
TASK_NODES, TASK_EDGES = 1 << 19, 1 << 19


def _forest(kind):
    """Arrow task: edges (u, hu, v, hv) to (node, root) for every node of the task's own components."""

    def run(batches):
        import pyarrow as pa

        parent: dict = {}
        rank: dict = {}

        def top(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def out():
            nodes = list(parent)
            return pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([top(n) for n in nodes], kind)], names=["node", "root"])

        for batch in batches:
            for u, hu, v, hv in zip(*(batch[c].to_pylist() for c in ("u", "hu", "v", "hv"))):
                for x, h in ((u, hu), (v, hv)):
                    if x not in parent:
                        parent[x], rank[x] = x, (h, x)
                x, y = top(u), top(v)
                if x != y:
                    if rank[y] < rank[x]:
                        x, y = y, x
                    parent[y] = x
            if len(parent) > TASK_NODES:
                yield out()
                parent.clear()
                rank.clear()
        if parent:
            yield out()

    return run


def labels(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node of an edge; nodes have one root exactly if edges connect them.

    Each task first joins what its own edges connect, so that it hands on one row for each of its nodes.  A node then takes
    one of the roots that tasks gave it, and its other roots, as edges to that one, are the next and smaller graph.  A round is
    one shuffle and one write, which also counts the edges left; the rounds end when there are none.  The order that
    chooses roots is dealt anew in every round, so chains shrink too.  A hub's row holds at most one root for each task.
    Null ends are ignored, an edge to itself names a component of one, and no edges give no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    kind = links.schema["u"].dataType
    found, left, number = None, None, 0
    while left is None or left > 0:
        if left is not None:
            links = links.repartition(math.ceil(left / TASK_EDGES), "u")
        rank = lambda c: F.xxhash64(F.lit(number), F.col(c))  # noqa: B023,E731
        ranked = links.select("u", rank("u").alias("hu"), "v", rank("v").alias("hv"))
        stars = ranked.mapInArrow(_forest(to_arrow_type(kind)), f"node {kind.simpleString()}, root {kind.simpleString()}")
        taken = stars.groupBy("node").agg(F.collect_set(F.struct(rank("root").alias("h"), "root")).alias("roots"))
        taken = taken.select("node", F.array_min("roots")["root"].alias("root"), F.col("roots")["root"].alias("all"))
        taken = taken.select("node", "root", F.filter("all", lambda x: x != F.col("root")).alias("others"))
        seen = Observation()
        level = durable(taken.observe(seen, F.coalesce(F.sum(F.size("others")), F.lit(0)).alias("left")))
        left, number = int(seen.get["left"]), number + 1
        links = level.where(F.size("others") > 0).select(F.explode("others").alias("u"), F.col("root").alias("v"))
        step = level.select(F.col("node").alias("root"), F.col("root").alias("next"))
        if found is None:
            found = level.select("node", "root")
        else:
            found = found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return found


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` as of :func:`labels`; ``root`` is the smallest node that can be reached."""
    found = durable(labels(edges, a, b))
    least = found.groupBy("root").agg(F.min("node").alias("least"))
    return found.join(least, "root").select("node", F.col("least").alias("root"))
