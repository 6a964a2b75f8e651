"""Ranks in a graph of precedence: values in a cycle are one, the longest chain up to a value is its rank.

A graph of up to GRAPH_EDGES edges is ranked by one task, in time linear in the edges; a larger one by rounds of joins,
as many as the longest chain. Both give the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.session import checkpoint

#: Edges that one task holds, some hundred bytes each.
GRAPH_EDGES = 1_000_000
RANKED = "fld string, val string, rank int, part string"


def rank_graph(edges: list[tuple]) -> dict:
    """{node: (rank, part)} of a list of (a, b): rank as in ranks, part the least node connected with it."""
    after: dict = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    # components of cycles, the last ones first, by depth-first search without recursion
    number, low, on, stack, comp, order = {}, {}, set(), [], {}, []
    for root in after:
        if root in number:
            continue
        work = [(root, iter(after[root]))]
        number[root] = low[root] = len(number)
        stack.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in number:
                    number[w] = low[w] = len(number)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(after[w])))
                    break
                if w in on:
                    low[v] = min(low[v], number[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == number[v]:
                    own = []
                    while not own or own[-1] != v:
                        own.append(stack.pop())
                        on.discard(own[-1])
                    for w in own:
                        comp[w] = len(order)
                    order.append(own)
    rank = [0] * len(order)
    for c in range(len(order) - 1, -1, -1):
        for v in order[c]:
            for w in after[v]:
                if comp[w] != c:
                    rank[comp[w]] = max(rank[comp[w]], rank[c] + 1)
    # connected parts, by union
    parent = {v: v for v in after}

    def top(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in edges:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    return {v: (rank[comp[v]], top(v)) for v in after}


def _one_task(batches: Iterator) -> Iterator:
    import pyarrow as pa

    by: dict = {}
    for b in batches:
        for f, x, y in zip(*(b[c].to_pylist() for c in ("fld", "a", "b"))):
            by.setdefault(f, []).append((x, y))
    for f, edges in by.items():
        found = rank_graph(edges)
        yield pa.RecordBatch.from_arrays([pa.array([f] * len(found)), pa.array(list(found)), pa.array([r for r, _ in found.values()], pa.int32()), pa.array([p for _, p in found.values()])], names=["fld", "val", "rank", "part"])


def _fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Applies `step`, which gives (v, x) rows and whether each `_moved`, until none moves."""
    now = checkpoint(start)
    while True:
        new = checkpoint(step(now))
        if not new.where("_moved").limit(1).count():
            return new.drop("_moved")
        now = new.drop("_moved")


def _spread(nodes: DataFrame, edges: DataFrame, plus: int = 0) -> DataFrame:
    """(v, x): the largest x + plus * (length of the way) over all ways of `edges` (a, b) to v."""

    def step(now: DataFrame) -> DataFrame:
        sent = edges.join(now, F.col("a") == F.col("v")).groupBy(F.col("b").alias("_b")).agg(F.max(F.col("x") + F.lit(plus) if plus else F.col("x")).alias("_x"))
        joined = now.join(sent, F.col("v") == F.col("_b"), "left")
        return joined.select("v", F.greatest("x", "_x").alias("x"), F.coalesce(F.col("_x") > F.col("x"), F.lit(False)).alias("_moved"))

    return _fixpoint(nodes, step)


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("v")).union(edges.select(F.col("b").alias("v"))).distinct()


def _in_cycles(edges: DataFrame) -> DataFrame:
    """(v, comp): the nodes that are in a cycle, and a name of all that are in it together."""
    found = None
    left = checkpoint(edges)
    n = left.count()
    while n:
        # what nothing leads to, or what leads nowhere, is in no cycle
        while True:
            kept = left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
            left = checkpoint(kept.select("a", "b"))
            now = left.count()
            if now == n:
                break
            n = now
        if not n:
            break
        # every node takes the largest node that leads to it; those that lead back to that one are in a cycle with it
        color = _spread(_nodes(left).withColumn("x", F.col("v")), left)
        ca, cb = color.select(F.col("v").alias("a"), F.col("x").alias("ca")), color.select(F.col("v").alias("b"), F.col("x").alias("cb"))
        same = checkpoint(left.join(ca, "a").join(cb, "b").where("ca = cb"))
        back = _spread(color.select("v", (F.col("v") == F.col("x")).cast("int").alias("x")), same.select(F.col("b").alias("a"), F.col("a").alias("b")))
        own = back.where("x = 1").select("v").join(color, "v").select("v", F.col("x").alias("comp"))
        found = checkpoint(own if found is None else found.unionByName(own))
        gone = found.select("v")
        left = checkpoint(left.join(gone.withColumnRenamed("v", "a"), "a", "left_anti").join(gone.withColumnRenamed("v", "b"), "b", "left_anti").select("a", "b"))
        n = left.count()
    return found if found is not None else edges.select(F.col("a").alias("v"), F.col("a").alias("comp")).limit(0)


def _by_rounds(edges: DataFrame) -> DataFrame:
    """As _one_task, for any number of edges."""
    node = lambda c: F.concat_ws("\0", "fld", c)
    plain = checkpoint(edges.select(node("a").alias("a"), node("b").alias("b")))
    nodes = checkpoint(_nodes(plain))
    comp = _in_cycles(plain).withColumnRenamed("v", "_v")
    named = checkpoint(nodes.join(comp, F.col("v") == F.col("_v"), "left").select("v", F.coalesce("comp", "v").alias("comp")))
    to = lambda c: named.select(F.col("v").alias(c), F.col("comp").alias(f"c{c}"))
    between = checkpoint(plain.join(to("a"), "a").join(to("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    rank = _spread(named.select(F.col("comp").alias("v"), F.lit(0).alias("x")).distinct(), between, 1)
    both = plain.union(plain.select("b", "a"))
    # the least node of a part, as _one_task names it: the largest of names turned round
    turned = F.translate(F.hex("v"), "0123456789ABCDEF", "FEDCBA9876543210")
    part = _spread(nodes.withColumn("x", F.concat(turned, F.lit("G"))), both)
    part = part.select(F.col("v").alias("pv"), F.unhex(F.translate(F.rtrim(F.col("x"), F.lit("G")), "FEDCBA9876543210", "0123456789ABCDEF")).cast("string").alias("part"))
    out = named.join(rank.select(F.col("v").alias("comp"), F.col("x").alias("rank")), "comp").join(part, F.col("v") == F.col("pv"))
    bare = lambda c: F.expr(f"substring({c}, instr({c}, '\0') + 1)")
    return out.select(F.substring_index("v", "\0", 1).alias("fld"), bare("v").alias("val"), F.col("rank").cast("int").alias("rank"), bare("part").alias("part"))


def ranks(edges: DataFrame) -> DataFrame:
    """(fld, val, rank, part) of each value of a graph (fld, a, b), where b follows a.

    rank: the number of steps in the longest chain up to it, from 0; all values of a cycle have the same. part: the least value
    of those that edges connect it with, in either direction. Repeated edges and edges from a value to itself change nothing;
    null values have none.
    """
    edges = checkpoint(edges.select("fld", "a", "b").where("fld is not null and a is not null and b is not null"))
    if edges.count() <= GRAPH_EDGES:
        return checkpoint(edges.coalesce(1).mapInArrow(_one_task, RANKED))
    return checkpoint(_by_rounds(edges))
