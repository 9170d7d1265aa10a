"""Graph operators over edge tables (src, dst, weight)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard, table

#: Betweenness keeps the graph in each task; it is for bounded graphs such as top-edge excerpts.
MOST_EDGES = 200_000
#: Edges that seed_proximity keeps in one task.
MOST_HELD = 10_000_000
#: Walks end when no more than this of them is left at a node, or of a seed's own.
LEFT = 1e-9
#: Nodes of a block whose walks are solved as one matrix, and edges times seeds of one share of a block and of one step of it.
DENSE, SHARE, AT_ONCE = 1000, 20_000_000, 1 << 21


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, weight) with a < b, weights summed; self-loops go."""
    e = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return e.agg(F.sum("weight").alias("weight"))


def pagerank(edges: DataFrame, rounds: int = 500, damping: float = 0.85, weighted: bool = False, restart: DataFrame | None = None, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank) when ranks change by less than ``tolerance`` a node in sum, or after ``rounds``; rank that ends in nodes without edges out goes back to the restart nodes (all, if none are given)."""
    e = edges.groupBy("src", "dst").agg((F.sum("weight") if weighted else F.max(F.lit(1.0))).alias("w"))
    out = e.groupBy("src").agg(F.sum("w").alias("total"))
    e = cut(e.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("part")))
    nodes = cut(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    start = nodes if restart is None else nodes.join(restart.select("node").distinct(), "node", "left_semi")
    n = start.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    jump = cut(nodes.join(start.withColumn("jump", F.lit(1.0 / n)), "node", "left").na.fill(0.0, ["jump"]).join(out.select(F.col("src").alias("node"), F.lit(1).alias("has_out")), "node", "left"))
    ranks, size = jump.select("node", F.col("jump").alias("rank")), nodes.count()
    last = ranks
    for _ in range(rounds):
        lost = ranks.join(jump.where("has_out IS NULL").select("node"), "node", "left_semi").agg(F.sum("rank")).first()[0] or 0.0
        got = e.join(ranks.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("part")).alias("got"))
        after = cut(jump.join(got, "node", "left").join(ranks.withColumnRenamed("rank", "was"), "node").select("node", (F.col("jump") * (1 - damping + damping * lost) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"), "was"))
        change = after.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0]
        discard(last)
        ranks, last = after.drop("was"), after
        if change < tolerance * size:
            break
    return ranks


def smallest_labels(edges: DataFrame) -> DataFrame:
    """(node, component): components by smallest labels, with pointers shortened each round."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    last = labels = cut(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        step = step.join(labels.select(F.col("node").alias("low"), F.col("component").alias("lower")), "low", "left")
        step = cut(step.select("node", F.least("low", F.coalesce("lower", "low")).alias("component"), F.col("component").alias("before")))
        discard(last)
        last = step
        if step.where("component <> before").isEmpty():
            return step.select("node", "component")
        labels = step.drop("before")


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, community) by label propagation: each round a node takes the label of most weight around it, ties by the smaller."""
    e = undirected(edges)
    both = cut(e.select(F.col("a").alias("x"), F.col("b").alias("y"), "weight").union(e.select("b", "a", "weight")))
    labels = both.select(F.col("x").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x", "community").agg(F.sum("weight").alias("v"))
        last = labels
        labels = cut(votes.groupBy("x").agg(F.min(F.struct((-F.col("v")).alias("v"), "community"))["community"].alias("community")).withColumnRenamed("x", "node"))
        discard(last)
    return labels


def betweenness(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(node, betweenness): shortest paths through each node of an undirected graph, normalized; from all nodes or scaled up from ``sources``."""
    e = undirected(edges).select("a", "b")
    links = [tuple(r) for r in e.limit(MOST_EDGES + 1).collect()]
    if len(links) > MOST_EDGES:
        raise ValueError(f"more than {MOST_EDGES} edges; take an excerpt")
    near: dict = {}
    for a, b in links:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    chosen = nodes if sources is None else nodes.join(sources, "node", "left_semi")
    n, k = len(near), chosen.count()

    def through(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for batch in batches:
            for s in batch["node"]:
                order, before, paths, far = [], {}, {s: 1.0}, {s: 0}
                todo = deque([s])
                while todo:
                    v = todo.popleft()
                    order.append(v)
                    for w in near[v]:
                        if w not in far:
                            far[w] = far[v] + 1
                            todo.append(w)
                        if far[w] == far[v] + 1:
                            paths[w] = paths.get(w, 0.0) + paths[v]
                            before.setdefault(w, []).append(v)
                share = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in before.get(w, ()):
                        share[v] += paths[v] / paths[w] * (1 + share[w])
                    if w != s:
                        total[w] = total.get(w, 0.0) + share[w]
        yield pd.DataFrame({"node": list(total), "b": list(total.values())})

    scale = 1.0 / ((n - 1) * (n - 2)) * (n / k) if n > 2 and k else 0.0
    kind = nodes.schema["node"].dataType.simpleString()
    sums = chosen.mapInPandas(through, f"node {kind}, b double").groupBy("node").agg(F.sum("b").alias("b"))
    return nodes.join(sums, "node", "left").select("node", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def seed_proximity(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, most: int = MOST_HELD) -> DataFrame:
    """(node, proximity): personalised ranks from each seed (column ``node``), summed without a seed's own rank for itself.

    Ranks follow the weights of edges; a node whose edges out have no weight has none, and what ends there goes back to the seed.

    The ranks of seed s are those visits that a damped walk from s makes, over its length h(s). Both are linear: lengths solve h = 1 + damping P h, and
    the sum over all seeds is what walks make of a start of 1 / h at each, so two passes over the graph serve all seeds. Only a seed's
    own rank needs a walk of its own, and only within the circles through it: its strong component. Up to ``most`` edges the graph is kept in one
    task, and beyond it goes through the rounds as tables.
    """
    e = cut(edges.groupBy("src", "dst").agg(F.sum("weight").alias("w")))
    names = cut(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("id", F.monotonically_increasing_id()))
    out = e.groupBy("src").agg(F.sum("w").alias("total")).where("total > 0")
    parts = e.where("w > 0").join(out, "src").select("src", "dst", (damping * F.col("w") / F.col("total")).alias("part"))
    for c in ("src", "dst"):
        parts = parts.join(names.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id")), c)
    parts = cut(parts.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "part"))
    starts = cut(seeds.select("node").distinct().join(names, "node").select("id"))
    run = _held_visits if parts.count() <= most else _joined_visits
    found, inner = run(parts, names.select("id"), starts)
    own = _own_visits(inner, starts.join(found, "id").select("id", "block"))
    df = names.join(found, "id", "left").join(starts.withColumn("seed", F.lit(True)), "id", "left").join(own, "id", "left")
    kept = F.when(F.col("seed"), F.coalesce("visits", F.lit(1.0)) / F.coalesce("h", F.lit(1.0))).otherwise(0.0)
    return df.select("node", F.greatest(F.coalesce("t", F.when(F.col("seed"), 1.0), F.lit(0.0)) - kept, F.lit(0.0)).alias("proximity"))


def _strong_blocks(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The strong component of each of ``n`` nodes, -1 where no circle leads through it."""
    block = np.full(n, -1)
    on = np.ones(len(src), bool)
    while True:  # nodes without a way in or out lie on no circle
        alive = (np.bincount(src[on], minlength=n) > 0) & (np.bincount(dst[on], minlength=n) > 0)
        less = on & alive[src] & alive[dst]
        if less.sum() == on.sum():
            break
        on = less
    s, d = src[on], dst[on]
    order = np.argsort(s, kind="stable")
    s, d = s[order], d[order]
    first = np.searchsorted(s, np.arange(n + 1)).tolist()
    d = d.tolist()
    index, low, held, stack, count = [-1] * n, [0] * n, bytearray(n), [], 0
    for root in np.unique(s).tolist():
        if index[root] >= 0:
            continue
        todo = [(root, first[root])]
        index[root] = low[root] = count
        count += 1
        stack.append(root)
        held[root] = 1
        while todo:
            v, at = todo.pop()
            while at < first[v + 1]:
                w = d[at]
                at += 1
                if index[w] < 0:
                    todo += [(v, at), (w, first[w])]
                    index[w] = low[w] = count
                    count += 1
                    stack.append(w)
                    held[w] = 1
                    break
                if held[w]:
                    low[v] = min(low[v], index[w])
            else:
                if low[v] == index[v]:
                    while True:
                        w = stack.pop()
                        held[w] = 0
                        block[w] = v
                        if w == v:
                            break
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[v])
    return block


def _held_visits(parts: DataFrame, nodes: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, h, t, block), (src, dst, part, block) of edges within blocks); one task keeps the edges."""

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(b["src"].to_numpy(), b["dst"].to_numpy(), b["part"].to_numpy()) for b in batches]
        if not rows:
            return
        src, dst, part = (np.concatenate(c) for c in zip(*rows, strict=True))
        begun, real = src[dst < 0], dst >= 0
        src, dst, part = src[real], dst[real], part[real]
        ids = np.unique(np.concatenate([src, dst, begun]))
        src, dst, begun = (np.searchsorted(ids, x).astype(np.int32) for x in (src, dst, begun))
        n = len(ids)

        def summed(start: np.ndarray, of: np.ndarray, to: np.ndarray) -> np.ndarray:
            x = step = start
            while step.max(initial=0.0) > LEFT:
                step = np.bincount(to, step[of] * part, n)
                x = x + step
            return x

        h = summed(np.ones(n), dst, src)
        w = np.zeros(n)
        w[begun] = 1 / h[begun]
        t = summed(w, src, dst)
        block = _strong_blocks(src, dst, n)
        for at in range(0, n, 100_000):
            now = slice(at, at + 100_000)
            yield pd.DataFrame({"id": ids[now], "h": h[now], "t": t[now], "block": np.where(block[now] >= 0, ids[block[now]], -1)})

    rows = parts.unionByName(starts.select(F.col("id").alias("src"), F.lit(-1).cast("long").alias("dst"), F.lit(0.0).alias("part")))
    found = cut(rows.coalesce(1).mapInPandas(solved, "id long, h double, t double, block long"))
    at = found.where("block >= 0").select("id", "block")
    inner = parts.join(at.withColumnRenamed("id", "src"), "src").join(at.withColumnsRenamed({"id": "dst", "block": "to"}), "dst").where("block = to")
    return found, cut(inner.select("src", "dst", "part", "block"))


def _joined_visits(parts: DataFrame, nodes: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``_held_visits``, by rounds over tables of one row a node; a block is what hangs together by edges that may lie on a circle."""

    def summed(start: DataFrame, of: str, to: str) -> DataFrame:
        x = cut(start.select("id", "x", F.col("x").alias("step")))
        while (x.agg(F.max("step")).first()[0] or 0.0) > LEFT:
            step = parts.join(x.where("step > 0").select(F.col("id").alias(of), "step"), of).groupBy(F.col(to).alias("id")).agg(F.sum(F.col("part") * F.col("step")).alias("more"))
            last, x = x, cut(x.join(step, "id", "left").select("id", (F.col("x") + F.coalesce("more", F.lit(0.0))).alias("x"), F.coalesce("more", F.lit(0.0)).alias("step")))
            discard(last)
        return x.drop("step")

    h = summed(nodes.withColumn("x", F.lit(1.0)), "dst", "src").withColumnRenamed("x", "h")
    w = h.join(starts.withColumn("seed", F.lit(1.0)), "id", "left").select("id", F.coalesce(F.col("seed") / F.col("h"), F.lit(0.0)).alias("x"))
    t = summed(w, "src", "dst").withColumnRenamed("x", "t")
    inner, n = parts, parts.count()
    while True:
        less = inner.join(inner.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(inner.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        inner, before = cut(less), n
        n = inner.count()
        if n == before:
            break
    if n:
        blocks = cut(smallest_labels(inner).withColumnsRenamed({"node": "id", "component": "block"}))
    else:
        blocks = nodes.limit(0).withColumn("block", F.col("id"))
    inner = cut(inner.join(blocks.withColumnRenamed("id", "src"), "src").select("src", "dst", "part", "block"))
    return cut(h.join(t, "id").join(blocks, "id", "left").na.fill(-1, ["block"])), inner


def _own_visits(inner: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, visits): how often a damped walk from each seed is expected at the seed, 1 for those on no circle; the seeds of a block are dealt to several groups, each with the block's edges."""
    starts = cut(starts.where("block >= 0"))
    sizes = inner.groupBy("block").agg(F.count("*").alias("m")).join(starts.groupBy("block").agg(F.count("*").alias("k")), "block")
    most = 4 * inner.sparkSession.sparkContext.defaultParallelism
    shares = cut(sizes.select("block", F.least(F.ceil(F.col("m") * F.col("k") / SHARE), F.lit(most)).cast("int").alias("shares")))
    of = F.pmod(F.xxhash64("id"), F.col("shares")).cast("int")
    left = starts.join(shares, "block").select("block", of.alias("share"), "id")
    right = inner.join(shares, "block").select("block", "src", "dst", "part", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))

    def walked(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": a["id"], "visits": 1.0})
        ids = np.unique(np.concatenate([b["src"], b["dst"]]))
        src, dst, part = np.searchsorted(ids, b["src"]), np.searchsorted(ids, b["dst"]), b["part"].to_numpy()
        n, own = len(ids), np.searchsorted(ids, a["id"])
        if n <= DENSE:
            m = np.eye(n)
            np.subtract.at(m, (src, dst), part)
            return pd.DataFrame({"id": a["id"], "visits": np.diag(np.linalg.inv(m))[own]})
        order = np.argsort(dst, kind="stable")
        src, dst, part = src[order], dst[order], part[order]
        to, first = np.unique(dst, return_index=True)
        back = np.zeros(len(own))
        wide = max(1, min(32, AT_ONCE // len(src)))
        for at in range(0, len(own), wide):
            s = own[at : at + wide]
            x = np.zeros((n, len(s)))
            k = np.arange(len(s))
            x[s, k] = 1.0
            # what comes back to the seed ends there
            while x.sum(0).max() > LEFT:
                x_, x = x, np.zeros_like(x)
                x[to] = np.add.reduceat(x_[src] * part[:, None], first)
                back[at : at + wide] += x[s, k]
                x[s, k] = 0.0
        return pd.DataFrame({"id": a["id"], "visits": 1 / (1 - back)})

    return cut(left.groupBy("block", "share").cogroup(right.groupBy("block", "share")).applyInPandas(walked, "id long, visits double"))


def _edges(spark, sf_dir: str) -> DataFrame:
    from ..plans.network import grant_edges

    return grant_edges(spark, sf_dir).select(F.col("source_ein").alias("src"), F.col("target_ein").alias("dst"), F.greatest("total_amount", F.lit(0.0)).alias("weight"))


def grant_pagerank(spark, sf_dir: str) -> DataFrame:
    return pagerank(_edges(spark, sf_dir), tolerance=1e-9).select("node", F.round("rank", 6).alias("rank"))


def grant_components(spark, sf_dir: str) -> DataFrame:
    return smallest_labels(_edges(spark, sf_dir))


def grant_communities(spark, sf_dir: str) -> DataFrame:
    return communities(_edges(spark, sf_dir))


def top_edges(spark, sf_dir: str, n: int = 250) -> DataFrame:
    """The ``n`` largest edges, ties by their ends."""
    return _edges(spark, sf_dir).orderBy(F.desc("weight"), "src", "dst").limit(n)


def grant_betweenness(spark, sf_dir: str) -> DataFrame:
    return betweenness(top_edges(spark, sf_dir)).select("node", F.round("betweenness", 8).alias("betweenness"))


def conduit_proximity(spark, sf_dir: str) -> DataFrame:
    """Proximity to the EINs of all politically active filers."""
    seeds = table(spark, sf_dir, "irs990_filings").where("political_activity_flag = 1 AND ein IS NOT NULL").select(F.col("ein").alias("node"))
    return seed_proximity(_edges(spark, sf_dir), seeds)


QUERIES = {f.__name__: f for f in (grant_pagerank, grant_components, grant_communities, top_edges, grant_betweenness, conduit_proximity)}
_E = """SELECT ein AS src, trim(grantee_ein) AS dst, greatest(round(sum(amount), 2), 0) AS weight FROM irs990_filing_grants g JOIN irs990_filings f USING (filing_id)
 WHERE ein IS NOT NULL AND trim(grantee_ein) <> '' GROUP BY 1, 2"""
_STEP = """ r{k} AS (SELECT n.node, (1 - 0.85) / n.c + 0.85 * (SELECT coalesce(sum(p.rank), 0) FROM r{j} p WHERE p.node NOT IN (SELECT src FROM o)) / n.c
   + 0.85 * coalesce((SELECT sum(p.rank / o.d) FROM e JOIN r{j} p ON p.node = e.src JOIN o ON o.src = e.src WHERE e.dst = n.node), 0) AS rank FROM nodes n)"""
SQL = {
    "grant_pagerank": f"WITH e AS ({_E}), o AS (SELECT src, count(*) AS d FROM e GROUP BY 1), v AS (SELECT src AS node FROM e UNION SELECT dst FROM e), nodes AS (SELECT node, (SELECT count(*) FROM v) AS c FROM v), r0 AS (SELECT node, 1.0 / c AS rank FROM nodes),"
    + ",".join(_STEP.format(k=k, j=k - 1) for k in range(1, 16))
    + " SELECT node, round(rank, 6) AS rank FROM r15",
    "grant_components": f"WITH RECURSIVE e AS ({_E}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(s, v) AS (SELECT src, src FROM b UNION SELECT r.s, b.dst FROM r JOIN b ON b.src = r.v) SELECT v AS node, min(s) AS component FROM r GROUP BY 1",
    "top_edges": f"SELECT * FROM ({_E}) ORDER BY weight DESC, src, dst LIMIT 250",
}
