"""Dependency order over edge tables (src, dst), src depends on dst: components of cycles, levels, positions.

A large graph is worked down in rounds that read and write tables: ends are trimmed, cycles found by colours. What is left
goes to one task as soon as it has at most LOCAL edges, so long chains and small graphs cost no rounds. The result is the
same either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.tables import written

#: Edges that one task takes at most.
LOCAL = 200_000


def _plain(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).filter("src <> dst").distinct()


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def _in_one_task(edges: DataFrame, work, schema: str) -> DataFrame:
    """The result of work(list of edges) over a bounded table, in a task of its own."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [x for part in parts for x in zip(part["src"], part["dst"])]
        yield work(rows)

    return edges.select("src", "dst").repartition(1).mapInPandas(run, schema)


def cycles(edges: list[tuple[str, str]]) -> dict[str, str]:
    """Of each node the least member of its strongly connected component; an own stack instead of recursion."""
    after: dict[str, list[str]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    waiting: list[str] = []
    inside: set[str] = set()
    out: dict[str, str] = {}
    for root in after:
        if root in number:
            continue
        path = [(root, iter(after[root]))]
        number[root] = low[root] = len(number)
        waiting.append(root)
        inside.add(root)
        while path:
            node, rest = path[-1]
            for n in rest:
                if n not in number:
                    number[n] = low[n] = len(number)
                    waiting.append(n)
                    inside.add(n)
                    path.append((n, iter(after[n])))
                    break
                if n in inside:
                    low[node] = min(low[node], number[n])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == number[node]:
                    members = [waiting.pop()]
                    while members[-1] != node:
                        members.append(waiting.pop())
                    inside.difference_update(members)
                    least = min(members)
                    out.update((m, least) for m in members)
    return out


def heights(edges: list[tuple[str, str]], first: int = 0) -> dict[str, int]:
    """Of each node of an acyclic graph one more than the highest it depends on; leaves have the first level."""
    before: dict[str, list[str]] = {}
    left: dict[str, int] = {}
    for a, b in edges:
        before.setdefault(b, []).append(a)
        left[a] = left.get(a, 0) + 1
        left.setdefault(b, 0)
    level = {n: first for n, k in left.items() if not k}
    todo = list(level)
    while todo:
        node = todo.pop()
        for a in before.get(node, ()):
            level[a] = max(level.get(a, first), level[node] + 1)
            left[a] -= 1
            if not left[a]:
                todo.append(a)
    return level


def _extreme(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(node, value): the least value that reaches the node along the edges from dst to src, its own included."""
    values = written(values.select("node", "value"), "colours")
    while True:
        via = edges.join(values.select(F.col("node").alias("dst"), F.col("value").alias("via")), "dst").groupBy(F.col("src").alias("node")).agg(F.min("via").alias("via"))
        new = values.join(via, "node", "left").select("node", F.least("value", "via").alias("value"), (F.col("via") < F.col("value")).alias("changed"))
        new = written(new, "colours")
        values = new.select("node", "value")
        if new.filter("changed").isEmpty():
            return values


def components(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """(node, component) of every node of the edges: the least node of the cycles it lies on, or itself.

    Nulls and edges of a node to itself are left out, repeated edges count once. Without edges there are no rows.
    """
    e = written(_plain(edges), "edges")
    nodes, found = _nodes(e), None
    n = e.count()
    while n > local:
        # what nothing depends on, or depends on nothing, lies on no cycle
        kept = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        kept = written(kept, "edges")
        left = kept.count()
        if left == n:  # nothing to trim: the least node that each one reaches is its colour
            colour = _extreme(e, _nodes(e).withColumn("value", F.col("node")))
            inner = e.join(colour.select(F.col("node").alias("src"), F.col("value").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("value").alias("b")), "dst").filter("a = b")
            inner = written(inner.select("src", "dst"), "edges")
            # of one colour, the node that gave it and what it reaches are one component
            start = colour.withColumn("value", F.when(F.col("node") == F.col("value"), F.col("value")))
            back = inner.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            reach = _extreme(back, start.select("node", F.coalesce("value", F.lit("\U0010ffff")).alias("value")))
            one = written(reach.join(colour.withColumnRenamed("value", "colour"), "node").filter("value = colour").select("node", F.col("colour").alias("component")), "components")
            found = one if found is None else found.unionByName(one)
            gone = one.select(F.col("node"))
            kept = written(e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"), "edges")
            left = kept.count()
        e, n = kept, left
    rest = _in_one_task(e, lambda rows: pd.DataFrame(list(cycles(rows).items()), columns=["node", "component"], dtype=object), "node string, component string")
    known = rest if found is None else rest.unionByName(found)
    return nodes.join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def dependency_order(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """(node, component, level): leaves have level 0, others one more than the highest that their component depends on.

    The members of a cycle share its component and level. Nulls and edges of a node to itself are left out.
    """
    e = written(_plain(edges), "edges")
    member = written(components(e, local), "components")
    of = lambda x: member.select(F.col("node").alias(x), F.col("component").alias(f"{x}_component"))
    c = e.join(of("src"), "src").join(of("dst"), "dst").select(F.col("src_component").alias("src"), F.col("dst_component").alias("dst")).filter("src <> dst").distinct()
    c = written(c, "edges")
    left = written(member.select(F.col("component").alias("node")).distinct(), "nodes")
    done, level, n = None, 0, c.count()
    while n > local:
        free = written(left.join(c.select(F.col("src").alias("node")).distinct(), "node", "left_anti").withColumn("level", F.lit(level)), "level")
        done = free if done is None else done.unionByName(free)
        if level % 32 == 31:  # a plan holds only so many tables
            done = written(done, "levels")
        left = written(left.join(free, "node", "left_anti"), "nodes")
        c = written(c.join(free.select(F.col("node").alias("dst")), "dst", "left_anti"), "edges")
        level, n = level + 1, c.count()
    rest = _in_one_task(c, lambda rows: pd.DataFrame(list(heights(rows, level).items()), columns=["node", "level"]), "node string, level int")
    rest = left.join(rest, "node", "left").select("node", F.coalesce("level", F.lit(level)).alias("level"))
    done = rest if done is None else done.unionByName(rest)
    return member.join(done.withColumnRenamed("node", "component"), "component").select("node", "component", "level")


def ordered_items(items: DataFrame, order: DataFrame, key: str, within: list[str], fallback: list[str]) -> DataFrame:
    """Items with their position (from 1) within a group: those that the order (within, key, pos) lists come first, in its
    order, the others after them by the fallback columns, which also break ties."""
    w = Window.partitionBy(*within).orderBy(F.col("pos").isNull(), "pos", *fallback)
    return items.join(order.select(*within, key, "pos"), [*within, key], "left").withColumn("position", F.row_number().over(w)).drop("pos")
