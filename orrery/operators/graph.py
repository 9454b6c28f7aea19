"""Strongly connected components, cycles and reachability as iterated joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.lineage import cut

#: Edges that one task takes at most: of a whole graph or of what is left of it, and of a weakly connected part.
TASK_EDGES, PART_EDGES = 200_000, 20_000
#: Starts whose distances are kept side by side.
STARTS = 128


def _trim(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Drops edges from nodes that nothing enters and into nodes that nothing leaves; none of them is in a cycle."""
    for _ in range(rounds):
        edges = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        edges = edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    return edges


def _spread(both: DataFrame, labels: DataFrame, hops: int) -> DataFrame:
    """``node, fw, bw`` after so many hops: the smallest labels among a node's own and those of the neighbours at either side."""
    for _ in range(hops):
        said = both.join(labels.withColumnRenamed("node", "at"), "at").select("node", F.when(F.col("ahead"), F.col("fw")).alias("fw"), F.when(~F.col("ahead"), F.col("bw")).alias("bw"))
        labels = labels.unionByName(said).groupBy("node").agg(F.min("fw").alias("fw"), F.min("bw").alias("bw"))
    return labels


def _jump(labels: DataFrame) -> DataFrame:
    """Labels of labels: what reaches the node that reaches a node reaches it too. Doubles what a label has seen."""
    far = labels.select(F.col("node").alias("f"), F.col("fw").alias("ff")), labels.select(F.col("node").alias("b"), F.col("bw").alias("bb"))
    j = labels.join(far[0], F.col("fw") == F.col("f")).join(far[1], F.col("bw") == F.col("b"))
    return j.select("node", F.col("ff").alias("fw"), F.col("bb").alias("bw"))


def _rows(batches: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    found = [b for b in batches if len(b)]
    return pd.concat(found, ignore_index=True) if found else pd.DataFrame(columns=columns)


def _ahead(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each node's successors begin, and all successors."""
    order = np.argsort(src, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))]), dst[order]


def _component_of(begin: list[int], to: list[int], n: int) -> list[int]:
    """The component's number of each of n nodes, by a depth-first search with a stack of open nodes."""
    seen, low, comp = [-1] * n, [0] * n, [-1] * n
    open_, clock, parts = [], 0, 0
    for root in range(n):
        if seen[root] >= 0:
            continue
        path, at = [root], [begin[root]]
        seen[root] = low[root] = clock
        clock += 1
        open_.append(root)
        while path:
            v, k = path[-1], at[-1]
            if k < begin[v + 1]:
                at[-1] = k + 1
                w = to[k]
                if seen[w] < 0:
                    seen[w] = low[w] = clock
                    clock += 1
                    open_.append(w)
                    path.append(w)
                    at.append(begin[w])
                elif comp[w] < 0 and seen[w] < low[v]:
                    low[v] = seen[w]
                continue
            path.pop()
            at.pop()
            if path and low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
            if low[v] == seen[v]:
                while True:
                    w = open_.pop()
                    comp[w] = parts
                    if w == v:
                        break
                parts += 1
    return comp


def _in_one_task(edges: DataFrame) -> DataFrame:
    """``node, scc`` of a graph of no more than ``TASK_EDGES`` edges."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = _rows(batches, ["src", "dst"])
        names = np.sort(pd.unique(pd.concat([e["src"], e["dst"]])))
        place = pd.Index(names)
        begin, to = _ahead(place.get_indexer(e["src"]), place.get_indexer(e["dst"]), len(names))
        comp = np.array(_component_of(begin.tolist(), to.tolist(), len(names)), np.int64)
        first = np.full(len(names), len(names))
        np.minimum.at(first, comp, np.arange(len(names)))
        yield pd.DataFrame({"node": names, "scc": names[first[comp]]})

    kind = edges.schema["src"].dataType.simpleString()
    return edges.repartition(1).mapInPandas(run, f"node {kind}, scc {kind}")


def strongly_connected(edges: DataFrame, hops: int = 3, max_rounds: int = 10_000, task_edges: int = TASK_EDGES) -> DataFrame:
    """``node, scc`` for every node of ``edges(src, dst)``; scc is the component's smallest node.

    Each round spreads two labels over the edges left until nothing changes: the smallest node that reaches a node, and the
    smallest that it reaches. Where both agree, that node and this one reach each other, so the node is done; the others
    go on with the edges inside their pair of labels. Only minima are aggregated, so hot nodes are combined before the
    shuffle. Nodes that no cycle can hold are trimmed first. Between two materialised tables labels move ``hops`` edges and
    are replaced by their own labels, which doubles their reach, so that long chains take few rounds; a round is over when
    their sums stand still (labels only fall). ``max_rounds`` guards against an endless loop and raises.

    A graph, or what is left of one, of at most ``task_edges`` edges (a bound, whatever the input) is finished by one task.
    """
    base = edges.select("src", "dst").where("src is not null and dst is not null")
    nodes = base.select(F.col("src").alias("node")).unionAll(base.select(F.col("dst").alias("node"))).distinct()
    left = cut(base.where("src <> dst").distinct())
    done, rounds, trimmed = [], 0, False
    while n := left.count():
        if n <= task_edges:
            done.append(_in_one_task(left))
            break
        if not trimmed:
            left, trimmed = cut(_trim(left, 1)), True
            continue
        both = left.select(F.col("src").alias("at"), F.col("dst").alias("node"), F.lit(True).alias("ahead")).unionAll(left.select(F.col("dst").alias("at"), F.col("src").alias("node"), F.lit(False).alias("ahead")))
        labels, was = both.select("node").distinct().select("node", F.col("node").alias("fw"), F.col("node").alias("bw")), None
        while True:
            rounds += 1
            if rounds > max_rounds:
                raise RuntimeError(f"components did not settle in {max_rounds} rounds")
            labels = cut(_jump(_spread(both, labels, hops)))
            now = labels.agg(F.sum(F.xxhash64("node", "fw", "bw").cast("decimal(38,0)"))).first()[0]
            if now == was:
                break
            was = now
        done.append(labels.where("fw = bw").select("node", F.col("fw").alias("scc")))
        rest = labels.where("fw <> bw").select("node", F.struct("fw", "bw").alias("part"))
        a, b = rest.select(F.col("node").alias("src"), F.col("part").alias("p")), rest.select(F.col("node").alias("dst"), F.col("part").alias("q"))
        left, trimmed = left.join(a, "src").join(b, "dst").where("p = q").select("src", "dst"), True
        left = cut(_trim(left, 1))
    found = nodes.select("node", F.col("node").alias("own"))
    if not done:
        return found.select("node", F.col("own").alias("scc"))
    of = done[0]
    for d in done[1:]:
        of = of.unionByName(d)
    return found.join(of, "node", "left").select("node", F.coalesce("scc", "own").alias("scc"))


def weak_parts(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``node, part``: the smallest node that can be reached when directions are ignored, for every node of ``edges(src, dst)``.

    The smallest label of the neighbours, then labels' own labels, until they stand still; a graph of at most
    ``task_edges`` edges is labelled by one task.
    """
    base = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    both = base.unionAll(base.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select(F.col("src").alias("at"), F.col("dst").alias("node"))
    if base.count() <= task_edges:
        return _in_one_task(base.unionAll(base.select(F.col("dst").alias("src"), F.col("src").alias("dst")))).withColumnRenamed("scc", "part")
    labels, was = both.select("node").distinct().withColumn("part", F.col("node")), None
    while True:
        said = both.join(labels.withColumnRenamed("node", "at"), "at").select("node", "part")
        low = labels.unionByName(said).groupBy("node").agg(F.min("part").alias("part"))
        labels = cut(low.join(low.select(F.col("node").alias("of"), F.col("part").alias("next")), F.col("part") == F.col("of")).select("node", F.col("next").alias("part")))
        now = labels.agg(F.sum(F.xxhash64("node", "part").cast("decimal(38,0)"))).first()[0]
        if now == was:
            return labels
        was = now


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """``node, scc`` of components of more than one node."""
    scc = cut(strongly_connected(edges))
    many = scc.groupBy("scc").agg(F.count("*").alias("n")).where("n > 1").select("scc")
    return scc.join(many, "scc").select("node", "scc")


def intra_cycle_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edge rows with both ends in one component: all kinds, repeats and self-loops."""
    a = members.select(F.col("node").alias("src"), F.col("scc").alias("scc"))
    b = members.select(F.col("node").alias("dst"), F.col("scc").alias("scc2"))
    return edges.join(a, "src").join(b, "dst").where("scc = scc2").drop("scc2")


def cycle_risks(members: DataFrame, lines: DataFrame | None = None, is_test: DataFrame | None = None) -> DataFrame:
    """``scc, length, sloc, risk_score, test_only``.

    Risk is log10 of the members' lines (``lines(node, sloc)``; a missing node has none; without the table each member is
    one line) times their number, 0 without lines; test_only if all members are in ``is_test(node)``.
    """
    m = members
    m = m.withColumn("sloc", F.lit(1)) if lines is None else m.join(lines.select("node", "sloc"), "node", "left")
    m = m.withColumn("t", F.lit(False)) if is_test is None else m.join(is_test.select("node", F.lit(True).alias("t")), "node", "left")
    g = m.groupBy("scc").agg(F.count("*").cast("int").alias("length"), F.sum(F.coalesce("sloc", F.lit(0))).cast("long").alias("sloc"), F.bool_and(F.coalesce("t", F.lit(False))).alias("test_only"))
    return g.select("scc", "length", "sloc", F.when(F.col("sloc") <= 0, 0.0).otherwise(F.log10("sloc") * F.col("length")).alias("risk_score"), "test_only")


def cycles(edges: DataFrame, lines: DataFrame | None = None, is_test: DataFrame | None = None, threshold: float = 0.0) -> DataFrame:
    """``nodes`` (sorted), ``length, risk_score, test_only`` of import cycles by falling risk, then by nodes."""
    members = cyclic_nodes(edges)
    lists = members.groupBy("scc").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    return cycle_risks(members, lines, is_test).join(lists, "scc").where(F.col("risk_score") >= threshold).select("nodes", "length", "risk_score", "test_only").orderBy(F.desc("risk_score"), "nodes")


def dependents(edges: DataFrame, start, transitive: bool = False, limit: int | None = None) -> tuple[DataFrame, bool]:
    """``path, distance`` of what depends on a node (see :func:`dependents_by`); and whether ``limit`` cut it."""
    kind = edges.schema["src"].dataType.simpleString()
    starts = edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("start"))
    out = dependents_by(edges, starts, None if transitive else 1, part_edges=0).select("path", "distance")
    if limit is None:
        return out, False
    limit = max(0, min(limit, 1000))
    return out.orderBy("distance", "path").limit(limit), out.limit(limit + 1).count() > limit


def dependents_by(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, hops: int = 3, part_edges: int = PART_EDGES, task_edges: int = TASK_EDGES) -> DataFrame:
    """``start, path, distance`` of what depends on each of many nodes ``starts(start)``, by a breadth-first search over
    reversed edges; up to ``max_depth`` edges away, or all.

    Weakly connected parts of at most ``part_edges`` edges are dealt over the tasks and searched there, from all their starts
    at once; no search leaves its part. In larger parts each round follows the frontier for ``hops`` edges, drops what was
    seen before, and keeps the shortest distance of the rest; those at the last hop are the next frontier. The search ends
    when it is empty, however long the chains are.
    """
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("path")).where("at <> path").distinct()
    seen = starts.select("start").where("start is not null").distinct()
    if max_depth == 1:
        return seen.select("start", F.col("start").alias("at")).join(back, "at").select("start", "path", F.lit(1).alias("distance")).where("path <> start")
    back = cut(back)
    if not part_edges:
        return _searched(back, seen, max_depth, hops)
    parts = cut(weak_parts(back.select(F.col("at").alias("src"), F.col("path").alias("dst")), task_edges).withColumnRenamed("node", "at"))
    sizes = back.join(parts, "at").groupBy("part").agg(F.count("*").alias("edges"))
    placed = cut(parts.join(sizes, "part").select("at", "part", (F.col("edges") <= part_edges).alias("small")))
    of = seen.join(placed.withColumnRenamed("at", "start"), "start")
    here = _searched_in_tasks(back.join(placed.where("small"), "at").select("part", "at", "path"), of.where("small").select("part", "start"), max_depth)
    if placed.where("not small").isEmpty():
        return here
    large = placed.where("not small").select("at")
    return here.unionByName(_searched(cut(back.join(large, "at", "left_semi")), of.where("not small").select("start"), max_depth, hops))


def _searched(back: DataFrame, starts: DataFrame, max_depth: int | None, hops: int) -> DataFrame:
    seen = starts.select("start", F.col("start").alias("path"), F.lit(0).alias("distance"))
    front, depth = seen, 0
    while max_depth is None or depth < max_depth:
        step, found = front, None
        for _ in range(hops if max_depth is None else min(hops, max_depth - depth)):
            step = step.select("start", F.col("path").alias("at"), "distance").join(back, "at").groupBy("start", "path").agg((F.min("distance") + 1).alias("distance"))
            found = step if found is None else found.unionByName(step)
            depth += 1
        # All of the frontier is as far as the last hop of the round before, so the first distance found is the shortest.
        new = cut(found.groupBy("start", "path").agg(F.min("distance").alias("distance")).join(seen, ["start", "path"], "left_anti"))
        seen, front = seen.unionByName(new), new.where(F.col("distance") == depth)
        if front.isEmpty():
            break
    return seen.where("distance > 0")


def _searched_in_tasks(back: DataFrame, starts: DataFrame, max_depth: int | None) -> DataFrame:
    """Distances within parts: ``back(part, at, path)`` and ``starts(part, start)`` of a part come to one task, in order."""
    rows = back.select("part", "at", "path").unionByName(starts.select("part", F.col("start").alias("at"), F.lit(None).cast(back.schema["path"].dataType).alias("path")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            # Parts that are whole are searched together; the last part of a batch may go on in the next one.
            last = batch["part"].to_numpy() == batch["part"].iloc[-1] if len(batch) else np.zeros(0, bool)
            if len(batch) and (not last.all() or (held and held[-1]["part"].iloc[-1] != batch["part"].iloc[-1])):
                whole = [*held, batch[~last]]
                yield from _distances(pd.concat(whole, ignore_index=True), max_depth)
                held = [batch[last]]
            elif len(batch):
                held.append(batch)
        if held:
            yield from _distances(pd.concat(held, ignore_index=True), max_depth)

    kind = back.schema["at"].dataType.simpleString()
    return rows.repartition("part").sortWithinPartitions("part").mapInPandas(run, f"start {kind}, path {kind}, distance int")


def _distances(rows: pd.DataFrame, max_depth: int | None) -> Iterator[pd.DataFrame]:
    """Breadth-first search from all starts of some whole parts; ``STARTS`` rows of distances are kept at a time."""
    edge = rows["path"].notna().to_numpy()
    codes, names = pd.factorize(pd.concat([rows["at"], rows["path"][edge]], ignore_index=True))
    at, path = codes[: len(rows)], codes[len(rows) :]
    begin, to = _ahead(at[edge], path, len(names))
    degree = np.diff(begin)
    names = np.asarray(names)
    starts = at[~edge]
    for lo in range(0, len(starts), STARTS):
        own = starts[lo : lo + STARTS]
        far = np.full((len(own), len(names)), -1, np.int32)
        row, node, depth = np.arange(len(own)), own, 0
        far[row, node] = 0
        while len(node) and (max_depth is None or depth < max_depth):
            depth += 1
            count = degree[node]
            ends = np.cumsum(count)
            step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(begin[node], count)
            row, node = np.repeat(row, count), to[step]
            new = far[row, node] < 0
            far[row[new], node[new]] = depth
            key = np.unique(row[new] * len(names) + node[new])
            row, node = np.divmod(key, len(names)) if len(names) else (key, key)
        i, j = np.nonzero(far > 0)
        if len(i):
            yield pd.DataFrame({"start": names[own[i]], "path": names[j], "distance": far[i, j]})
