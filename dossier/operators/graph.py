"""Graph analytics over entity and edge frames."""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.text import percent
from dossier.plans.components import connected_components
from dossier.session import discard, materialise, partitions

CONTROL, OWN_DEPTH, MONEY_DEPTH = 0.25, 6, 8
MIN_COMMUNITY, MAX_CROSS = 5, 3


def simple(edge: DataFrame) -> DataFrame:
    """The undirected simple graph: (u, v), u < v; loops and parallel edges fall away."""
    return edge.where("source_id <> target_id").select(F.least("source_id", "target_id").alias("u"), F.greatest("source_id", "target_id").alias("v")).distinct()


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))


def degrees(pairs: DataFrame) -> DataFrame:
    return both_ways(pairs).groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def components(entity: DataFrame, edge: DataFrame) -> DataFrame:
    """(id, component) of every entity; without edges it is its own component."""
    comp = connected_components(simple(edge), "u", "v")
    return entity.select("id").join(comp, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))


def paths(edge: DataFrame, start: DataFrame, depth: int, columns: dict[str, str], reach: DataFrame | None = None) -> DataFrame:
    """All simple directed paths of 1 to depth edges from the ids of start.

    columns maps a name to the edge column to be gathered along the path. One join for each hop, over
    edges pruned to columns; reach, if given, holds the ids from which a goal can be reached at all.
    A path holds no id twice. Paths of any number are rows of a table; none are cut.
    """
    e = edge.select(F.col("source_id").alias("_s"), F.col("target_id").alias("_t"), *[F.col(c).alias(f"_{n}") for n, c in columns.items()])
    if reach is not None:
        e = e.join(reach.select(F.col("id").alias("_t")), "_t", "left_semi")
    first = start.select(F.col("id").alias("_s")).distinct().join(e, "_s").where("_s <> _t")
    now = first.select(F.array("_s", "_t").alias("path"), *[F.array(f"_{n}").alias(n) for n in columns])
    out, made = [], []
    for _ in range(depth):
        now = materialise(now, "paths")
        made.append(now)
        if now.isEmpty():
            break
        out.append(now)
        step = now.join(e, F.element_at("path", -1) == F.col("_s")).where(~F.array_contains("path", F.col("_t")))
        now = step.select(F.array_append("path", F.col("_t")).alias("path"), *[F.array_append(n, F.col(f"_{n}")).alias(n) for n in columns])
    total = out[0] if out else now
    for x in out[1:]:
        total = total.union(x)
    return total.withColumn("hops", F.size("path") - 1)


def reachable_to(edge: DataFrame, goal: DataFrame, depth: int) -> DataFrame:
    """Ids from which an id of goal can be reached in at most depth edges, goals included."""
    back = edge.select("source_id", "target_id").distinct()
    seen = materialise(goal.select("id").distinct(), "reach")
    front = seen
    for _ in range(depth):
        front = materialise(front.join(back, F.col("id") == F.col("target_id")).select(F.col("source_id").alias("id")).distinct().join(seen, "id", "left_anti"), "front")
        if front.isEmpty():
            break
        seen = materialise(seen.union(front), "reach")
    return seen


def find_paths(entity: DataFrame, edge: DataFrame, source: str, target: str, max_hops: int = 4, limit: int = 25, cap: int = 25) -> tuple[DataFrame, bool]:
    """(paths, truncated) between entities by label, best first: path, types, labels-free score of confidences.

    Ends are found first and everything is anchored at them; sorting comes before the limit.
    """
    ends = lambda q: entity.where(F.col("label").contains(q)).orderBy("id").limit(cap).select("id")
    goal = materialise(ends(target), "goal")
    found = paths(edge, ends(source), max_hops, {"types": "edge_type", "confidences": "confidence"}, reachable_to(edge, goal, max_hops))
    hit = found.join(goal.select(F.col("id").alias("_g")), F.element_at("path", -1) == F.col("_g"), "left_semi")
    score = F.round(F.aggregate("confidences", F.lit(1.0), lambda a, x: a * x), 9)
    best = hit.select("path", "types", "hops", score.alias("score")).orderBy(F.desc("score"), "path", "types").limit(limit + 1)
    best = materialise(best, "best")
    more = best.count() > limit
    return best.orderBy(F.desc("score"), "path", "types").limit(limit), more


def render_path(path: DataFrame, entity: DataFrame) -> DataFrame:
    """Paths as text: A --[TYPE]--> B, with the score to two decimals."""
    at = path.withColumn("_n", F.monotonically_increasing_id()).select("_n", "types", "score", F.posexplode("path").alias("i", "id"))
    named = at.join(entity.select("id", "label"), "id", "left").withColumn("step", F.concat(F.when(F.col("i") > 0, F.concat(F.lit(" --["), F.get("types", F.col("i") - 1), F.lit("]--> "))).otherwise(""), F.coalesce("label", "id")))
    text = named.groupBy("_n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "step"))), lambda x: x["step"]), "").alias("text"), F.first("score").alias("score"))
    return text.select(F.concat("text", F.lit(" ("), F.format_number("score", 2), F.lit(")")).alias("text"))


def money_graph(edge: DataFrame) -> DataFrame:
    """Positive transfers summed over parallel edges of one currency."""
    cents = F.sum(F.col("amount").cast("decimal(28,4)")).cast("double")
    return edge.where("amount > 0 and source_id <> target_id").groupBy("source_id", "target_id", F.coalesce("currency", F.lit("")).alias("currency")).agg(cents.alias("amount"))


def trace_funds(edge: DataFrame, start: DataFrame, depth: int = MONEY_DEPTH) -> DataFrame:
    """Every simple chain of transfers from start: path, hops, amounts, currency (MIXED if several), total_in, bottleneck (null if mixed)."""
    found = paths(money_graph(edge), start, depth, {"amounts": "amount", "currencies": "currency"})
    mixed = F.size(F.array_distinct("currencies")) > 1
    return found.select(
        "path", F.size("amounts").alias("hops"), "amounts", F.when(mixed, "MIXED").otherwise(F.get("currencies", F.lit(0))).alias("currency"), F.get("amounts", F.lit(0)).alias("total_in"),
        F.when(~mixed, F.array_min("amounts")).alias("bottleneck"), F.array_sort(F.array_distinct("currencies")).alias("currencies"),
    )


def max_flow(edge: DataFrame, source: str, target: str) -> dict:
    """The largest flow in one currency; several currencies are an error, a missing end gives 0.

    Only edges on the way from source to target are gathered, parallel ones summed before.
    """
    money = money_graph(edge)
    spark = edge.sparkSession
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    n = money.select("source_id").distinct().count() + 1
    ahead = reachable_to(money.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")), one(source), min(n, 100))
    back = reachable_to(money, one(target), min(n, 100))
    on = money.join(ahead.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(back.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    rows = on.collect()
    kinds = {r["currency"] for r in rows}
    if len(kinds) > 1:
        raise ValueError(f"the ledger mixes currencies: {sorted(kinds)}")
    left: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for r in rows:
        left[r["source_id"]][r["target_id"]] += r["amount"]
    flow = 0.0
    while True:
        seen, queue = {source: None}, deque([source])
        while queue and target not in seen:
            u = queue.popleft()
            for v, c in left[u].items():
                if c > 1e-9 and v not in seen:
                    seen[v] = u
                    queue.append(v)
        if target not in seen or source == target:
            return {"flow": flow, "currency": next(iter(kinds), None)}
        way, v = [], target
        while seen[v] is not None:
            way.append((seen[v], v))
            v = seen[v]
        least = min(left[u][v] for u, v in way)
        for u, v in way:
            left[u][v] -= least
            left[v][u] += least
        flow += least


def infer_control(edge: DataFrame, threshold: float = CONTROL, depth: int = OWN_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(inferred, skipped): stakes through chains of OWNS, the products of shares summed over all simple paths.

    Pairs that own directly are left out, a missing share is skipped and never taken for all; the cap
    at one comes after the threshold. Of duplicate edges the largest share counts.
    """
    own = edge.where("edge_type = 'OWNS'")
    skipped = own.where("share_pct is null")
    held = own.where("share_pct is not null and source_id <> target_id").groupBy("source_id", "target_id").agg((F.max("share_pct") / 100).alias("share"))
    held = materialise(held, "own")
    found = paths(held, held.select(F.col("source_id").alias("id")), depth, {"shares": "share"})
    rows = found.select(F.get("path", F.lit(0)).alias("source_id"), F.element_at("path", -1).alias("target_id"), F.aggregate("shares", F.lit(1.0), lambda a, x: a * x).alias("p"), "hops", "path")
    sums = rows.groupBy("source_id", "target_id").agg(F.round(F.sum("p"), 9).alias("stake"), F.max("hops").alias("hops"), F.min_by("path", F.struct(-F.col("hops"), F.col("path"))).alias("chain"))
    out = sums.join(held, ["source_id", "target_id"], "left_anti").where(F.col("stake") >= threshold)
    text = F.concat(F.array_join("chain", " -> "), F.lit(" = "), percent(F.least(F.col("stake"), F.lit(1.0))))
    return out.select("source_id", "target_id", F.lit("OWNS").alias("edge_type"), F.round(F.least("stake", F.lit(1.0)), 4).alias("effective_pct"), "hops", "chain", text.alias("evidence"), F.lit("inferred").alias("provenance"), F.lit(True).alias("needs_review")), skipped


#: Edges of a component that one Python task may take on as arrays, and by a search node by node.
COMPONENT_EDGES, LOT_EDGES = 2_000_000, 200_000


def _adjacency(pdf: pd.DataFrame) -> tuple[list[str], list[list[int]]]:
    nodes = sorted({*pdf["u"], *pdf["v"]})
    at = {x: i for i, x in enumerate(nodes)}
    near: list[list[int]] = [[] for _ in nodes]
    for u, v in zip(pdf["u"], pdf["v"], strict=True):
        near[at[u]].append(at[v])
        near[at[v]].append(at[u])
    return nodes, [sorted(set(x)) for x in near]


def bridges_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges whose loss parts their component: low-links of an iterative depth-first search."""
    nodes, near = _adjacency(pdf)
    seen, low, out, clock = [-1] * len(nodes), [0] * len(nodes), [], 0
    for root in range(len(nodes)):
        if seen[root] >= 0:
            continue
        seen[root] = low[root] = clock
        clock += 1
        stack = [(root, -1, iter(near[root]))]
        while stack:
            u, parent, rest = stack[-1]
            v = next(rest, None)
            if v is None:
                stack.pop()
                if parent >= 0:
                    low[parent] = min(low[parent], low[u])
                    if low[u] > seen[parent]:
                        out.append(tuple(sorted((nodes[u], nodes[parent]))))
            elif v != parent:
                if seen[v] >= 0:
                    low[u] = min(low[u], seen[v])
                else:
                    seen[v] = low[v] = clock
                    clock += 1
                    stack.append((v, u, iter(near[v])))
    return pd.DataFrame(sorted(out), columns=["u", "v"])


#: Rounds of moves in a level of the community search; most levels settle long before.
LOUVAIN_ROUNDS = 64


def _turn(node: str, k: int) -> bool:
    """Whether a node may move in a round: half of them, so that neighbours do not swap for ever."""
    return zlib.crc32(f"{node}:{k}".encode()) % 2 == 0


def _summed(key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[at], np.add.reduceat(w[order], at)


def louvain_of(table: pa.Table) -> pa.Table:
    """(id, community) of whole components (u, v, component) by Louvain's moves in rounds; louvain_wide() is the same by joins.

    In a round each node whose turn it is moves to the neighbouring community that raises modularity
    most, its own or else the first by name if several do; all at once, in whole numbers. When no node
    wants to move, communities become nodes, named by their first member, until none are joined. Nodes
    are numbers in the order of their names; components that have settled don't change any more.
    """
    ends = pa.chunked_array([*table.column("u").chunks, *table.column("v").chunks], pa.string()).combine_chunks().dictionary_encode()
    ends = ends.combine_chunks() if isinstance(ends, pa.ChunkedArray) else ends
    by_name = np.asarray(pc.sort_indices(ends.dictionary))
    names, place = ends.dictionary.take(pa.array(by_name)), np.empty(len(by_name), np.int64)
    place[by_name] = np.arange(len(by_name))
    ends = place[np.asarray(ends.indices)]
    u, v = ends[: len(ends) // 2], ends[len(ends) // 2 :]
    part = table.column("component").combine_chunks().dictionary_encode()
    part = np.asarray((part.combine_chunks() if isinstance(part, pa.ChunkedArray) else part).indices)
    src, dst = np.append(u, v), np.append(v, u)
    w, node = np.ones(len(src), np.int64), np.arange(len(names))
    of = np.zeros(len(names), np.int64)
    of[u] = of[v] = part
    degree = np.bincount(src, minlength=len(names))
    total, member = np.bincount(of, degree).astype(np.int64)[of], node
    while True:
        n = len(node)
        comm = np.arange(n)
        for k in range(LOUVAIN_ROUNDS):
            mass = np.bincount(comm, degree, n).astype(np.int64)
            key, to = _summed(np.append(src * n + comm[dst], np.arange(n) * n + comm), np.append(w, np.zeros(n, np.int64)))
            x, c = key // n, key % n
            own = c == comm[x]
            gain = total[x] * to - degree[x] * (mass[c] - np.where(own, degree[x], 0))
            most = np.maximum.reduceat(gain, np.flatnonzero(np.append(True, x[1:] != x[:-1])))
            best = np.flatnonzero(gain == most[x])
            # Of a node's best ones the first by name; but a node whose own is one of them stays.
            best = best[np.append(True, x[best][1:] != x[best][:-1])]
            wish = np.ones(n, bool)
            wish[x[own & (gain == most[x])]] = False
            best = best[wish[x[best]]]
            if not len(best):
                break
            turn = np.fromiter((_turn(y, k) for y in names.take(pa.array(node[x[best]])).to_pylist()), bool, len(best))
            comm[x[best[turn]]] = c[best[turn]]
        first = np.full(n, n)
        np.minimum.at(first, comm, np.arange(n))
        to_name = first[comm]
        heads = np.unique(to_name)
        if len(heads) == n:
            break
        number = np.zeros(n, np.int64)
        number[heads] = np.arange(len(heads))
        fresh = number[to_name]
        member = fresh[member]
        degree, total, node = np.bincount(fresh, degree).astype(np.int64), total[heads], node[heads]
        a, b = fresh[src], fresh[dst]
        key, w = _summed((a * len(heads) + b)[a != b], w[a != b]) if (a != b).any() else (a[:0], w[:0])
        src, dst = key // len(heads), key % len(heads)
    return pa.table({"id": names, "community": names.take(pa.array(node[member]))})


def louvain_wide(tagged: DataFrame) -> DataFrame:
    """(id, community) of components (u, v, component) of any size, as louvain_of() gives them, by joins."""
    links = both_ways(tagged).join(tagged.select("u", "component").union(tagged.select("v", "component")).distinct(), "u").select("component", "u", "v", F.lit(1).cast("long").alias("w"))
    links = materialise(links, "wide-links")
    total = links.groupBy("component").agg(F.sum("w").alias("total"))
    node = materialise(links.groupBy("component", "u").agg(F.sum("w").alias("degree")).join(total, "component").select("u", "degree", "total"), "wide-nodes")
    member = node.select(F.col("u").alias("id"), F.col("u").alias("m"))
    links = links.select("u", "v", "w")
    wide = "decimal(38,0)"
    while True:
        now = node.withColumn("c", F.col("u"))
        for k in range(LOUVAIN_ROUNDS):
            now = materialise(now, "wide-round")
            to = links.join(now.select(F.col("u").alias("v"), "c"), "v").select("u", "c", "w").union(now.select("u", "c", F.lit(0).cast("long")))
            mass = now.groupBy("c").agg(F.sum("degree").alias("mass"))
            own = now.select("u", "degree", "total", F.col("c").alias("own"))
            each = to.groupBy("u", "c").agg(F.sum("w").alias("w")).join(mass, "c").join(own, "u")
            rest = F.col("mass") - F.when(F.col("c") == F.col("own"), F.col("degree")).otherwise(0)
            gain = F.col("total").cast("decimal(18,0)") * F.col("w").cast("decimal(18,0)") - F.col("degree").cast("decimal(18,0)") * rest.cast("decimal(18,0)")
            best = each.groupBy("u").agg(F.min(F.struct((-gain).cast(wide).alias("loss"), (F.col("c") != F.col("own")).alias("other"), "c")).alias("best"))
            after = now.join(best.select("u", F.col("best.c").alias("b")), "u").withColumn("wish", F.col("b") != F.col("c"))
            if after.where("wish").isEmpty():
                break
            turn = F.crc32(F.encode(F.concat("u", F.lit(f":{k}")), "UTF-8")) % 2 == 0
            now = after.select("u", "degree", "total", F.when(F.col("wish") & turn, F.col("b")).otherwise(F.col("c")).alias("c"))
        now = materialise(now, "wide-level")
        name = materialise(now.groupBy("c").agg(F.min("u").alias("name")), "wide-names")
        if name.count() == now.count():
            return member.select("id", F.col("m").alias("community"))
        named = now.join(name, "c").select("u", "name", "degree", "total")
        member = materialise(member.join(named.select(F.col("u").alias("m"), "name"), "m").select("id", F.col("name").alias("m")), "wide-members")
        a, b = named.select("u", F.col("name").alias("nu")), named.select(F.col("u").alias("v"), F.col("name").alias("nv"))
        links = materialise(links.join(a, "u").join(b, "v").where("nu <> nv").groupBy(F.col("nu").alias("u"), F.col("nv").alias("v")).agg(F.sum("w").alias("w")), "wide-links")
        node = materialise(named.groupBy(F.col("name").alias("u")).agg(F.sum("degree").alias("degree"), F.first("total").alias("total")), "wide-nodes")


def _by_component(pairs: DataFrame):
    comp = connected_components(pairs, "u", "v")
    return pairs.join(comp, F.col("u") == F.col("node")).select("u", "v", "component")


def _parted(pairs: DataFrame, label: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(u, v, component) of components of up to so many edges, and of larger ones."""
    tagged = materialise(_by_component(pairs), label)
    sizes = tagged.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return tagged.join(sizes.where(F.col("n") <= most), "component", "left_semi"), tagged.join(sizes.where(F.col("n") > most), "component", "left_semi")


def forests_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """Two forests of edges, the second of those the first leaves: an edge is a bridge of the whole if and only if it is one of them."""
    out, rest = [], sorted(zip(pdf["u"], pdf["v"], strict=True))
    for _ in range(2):
        root: dict[str, str] = {}

        def find(x: str) -> str:
            while root.setdefault(x, x) != x:  # noqa: B023
                root[x] = root[root[x]]  # noqa: B023
                x = root[x]  # noqa: B023
            return x

        left = []
        for u, v in rest:
            a, b = find(u), find(v)
            if a == b:
                left.append((u, v))
            else:
                root[a] = b
                out.append((u, v))
        rest = left
    return pd.DataFrame(out, columns=["u", "v"])


def bridges(edge: DataFrame) -> DataFrame:
    """(u, v) of all bridges.

    A component that one task may take on is one task's. A larger one is first thinned: its edges are
    dealt at random into lots of that size, of each two forests stay, which keeps every bridge and makes
    none; again until the lots lose no more than a tenth. What is left, at most two edges for each
    node, is one task's.
    """
    lot = min(COMPONENT_EDGES, LOT_EDGES)
    small, large = _parted(simple(edge), "bridges", lot)
    n, turn = large.count(), 0
    while n:
        lots = max(1, -(-n // lot))
        thin = large.withColumn("lot", F.pmod(F.xxhash64("u", "v", F.lit(turn)), F.lit(lots))).groupBy("component", "lot").applyInPandas(lambda key, pdf: forests_of(pdf).assign(component=key[0]), "u string, v string, component string")
        large = materialise(thin, "bridges")
        before, n, turn = n, large.count(), turn + 1
        if lots == 1 or n > 0.9 * before:
            break
    return small.union(large.select(*small.columns)).groupBy("component").applyInPandas(lambda pdf: bridges_of(pdf), "u string, v string")


def communities(edge: DataFrame) -> DataFrame:
    """(id, community) by Louvain inside each component: those that a task may take on in one, larger ones by joins, with the same result."""
    small, large = _parted(simple(edge), "louvain", COMPONENT_EDGES)
    # Many small components are one call's work.
    lots = max(partitions(edge.sparkSession), -(-small.count() // LOT_EDGES))
    out = small.withColumn("lot", F.pmod(F.xxhash64("component"), F.lit(lots))).groupBy("lot").applyInArrow(lambda table: louvain_of(table), "id string, community string")
    # Read several times by what compares communities.
    return materialise(out if large.isEmpty() else out.union(louvain_wide(large)), "louvain")


def _betweenness_wide(pairs: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, b), (u, v, b)), sums over the starts (id) by joins: Brandes (2001) for all starts at once, level by level."""
    near = materialise(both_ways(pairs), "wide-near")
    level = materialise(starts.select(F.col("id").alias("s"), F.col("id").alias("x"), F.lit(1.0).alias("ways")), "wide-level")
    levels, seen = [level], level.select("s", "x")
    while True:
        step = level.join(near, F.col("x") == F.col("u")).groupBy("s", F.col("v").alias("x")).agg(F.sum("ways").alias("ways")).join(seen, ["s", "x"], "left_anti")
        level = materialise(step, "wide-level")
        if level.isEmpty():
            break
        levels.append(level)
        # What a level reaches lies in it, the one before or the next.
        seen = level.select("s", "x").union(levels[-2].select("s", "x"))
    share, nodes, on = None, [], []
    for far, close in zip(levels[:0:-1], levels[-2::-1], strict=True):
        each = far.withColumn("share", F.lit(0.0)) if share is None else far.join(share, ["s", "x"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
        each = materialise(each, "wide-share")
        nodes.append(each.select(F.col("x").alias("id"), F.col("share").alias("b")))
        back = each.join(near, F.col("x") == F.col("u")).select("s", F.col("x").alias("y"), "share", F.col("ways").alias("wy"), F.col("v").alias("x")).join(close, ["s", "x"])
        back = materialise(back.select("s", "x", "y", (F.col("ways") / F.col("wy") * (1 + F.col("share"))).alias("c")), "wide-back")
        on.append(back.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"), F.col("c").alias("b")))
        share = back.groupBy("s", "x").agg(F.sum("c").alias("share"))
    union = lambda parts, ddl: reduce(DataFrame.union, parts) if parts else pairs.sparkSession.createDataFrame([], ddl)
    return union(nodes, "id string, b double").groupBy("id").agg(F.sum("b").alias("b")), union(on, "u string, v string, b double").groupBy("u", "v").agg(F.sum("b").alias("b"))


def betweenness(edge: DataFrame, pivots: int = 500, edges: bool = False) -> DataFrame:
    """(id, betweenness), normalised, from up to so many pivots; all nodes if there are no more. edges: (u, v, betweenness).

    Pivots are drawn by a hash. Up to COMPONENT_EDGES edges are broadcast, and each task runs Brandes'
    algorithm (2001) for its pivots; a larger graph is searched from all pivots at once by joins, with
    the same result.
    """
    pairs = materialise(simple(edge), "betweenness")
    spark = edge.sparkSession
    every = _numbered(degrees(pairs).select("id"))
    n = every.count()
    starts = every.orderBy(F.xxhash64("id"), "id").limit(pivots)
    scale = (n / max(1, min(n, pivots))) / max(1, (n * (n - 1)) if edges else (n - 1) * (n - 2))
    if pairs.count() > COMPONENT_EDGES:
        by_node, by_edge = _betweenness_wide(pairs, materialise(starts.select("id"), "pivots"))
    else:
        a, b = every.select(F.col("k").alias("i"), F.col("id").alias("u")), every.select(F.col("k").alias("j"), F.col("id").alias("v"))
        ends = materialise(pairs.join(a, "u").join(b, "v").select("u", "v", F.least("i", "j").cast("int").alias("i"), F.greatest("i", "j").cast("int").alias("j")), "ends")
        drawn = ends.select("i", "j").toArrow()
        i, j = (np.asarray(drawn.column(c)).astype(np.int32) for c in "ij")
        src, dst = np.append(i, j), np.append(j, i)
        order = np.argsort(src, kind="stable")
        shared = spark.sparkContext.broadcast((np.append(0, np.cumsum(np.bincount(src, minlength=n))), dst[order]))
        # Each task sends a row for each node or edge: no more tasks than can run in two rounds.
        tasks = max(1, min(partitions(spark), 2 * spark.sparkContext.defaultParallelism, n))
        start = spark.createDataFrame([(r["k"],) for r in starts.collect()], "s long").repartition(tasks)
        sums = start.mapInPandas(_brandes(shared, edges), "i int, j int, b double").groupBy("i", "j").agg(F.sum("b").alias("b"))
        by_node = None if edges else every.join(sums, F.col("k") == F.col("i")).select("id", "b")
        by_edge = ends.join(sums, ["i", "j"]).select("u", "v", "b") if edges else None
    if edges:
        return by_edge.select("u", "v", F.round(F.col("b") * scale, 9).alias("betweenness"))
    return every.select("id").join(by_node, "id", "left").select("id", F.round(F.coalesce("b", F.lit(0.0)) * scale, 9).alias("betweenness"))


def _numbered(ids: DataFrame) -> DataFrame:
    """ids with k, numbers from 0 without a gap: places in their partitions, behind what the partitions before hold."""
    spark = ids.sparkSession
    at = materialise(ids.withColumn("m", F.monotonically_increasing_id()), "nodes")
    sizes = sorted(map(tuple, at.groupBy(F.shiftright("m", 33).alias("p")).agg(F.count(F.lit(1))).collect()))
    before = np.append(0, np.cumsum([x for _, x in sizes]))
    shift = spark.createDataFrame([(int(p), int(k)) for (p, _), k in zip(sizes, before, strict=False)], "p long, before long")
    return materialise(at.withColumn("p", F.shiftright("m", 33)).join(F.broadcast(shift), "p").select("id", (F.col("before") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("k")), "nodes")


def _brandes(shared, edges: bool):
    """Brandes' sums for the pivots of a task; a level of the search is one step over arrays."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ptr, dst = shared.value
        n = len(ptr) - 1
        total, on = np.zeros(n), np.zeros(len(dst) if edges else 0)
        for frame in frames:
            for s in frame["s"]:
                seen, ways, front, levels = np.zeros(n, bool), np.zeros(n), np.array([s]), []
                seen[s], ways[s] = True, 1.0
                while len(front):
                    count = ptr[front + 1] - ptr[front]
                    at = np.repeat(ptr[front] - np.cumsum(count) + count, count) + np.arange(count.sum())
                    fresh = ~seen[dst[at]]
                    at, near = at[fresh], np.repeat(front, count)[fresh]
                    sums = np.bincount(dst[at], ways[near], n)
                    front = np.flatnonzero(sums)
                    seen[front] = True
                    ways[front] = sums[front]
                    levels.append((at.astype(np.int32), near.astype(np.int32)))
                share = np.zeros(n)
                for at, near in reversed(levels):
                    far = dst[at]
                    c = ways[near] / ways[far] * (1 + share[far])
                    share += np.bincount(near, c, n)
                    if edges:
                        on[at] += c
                share[s] = 0
                total += share
        if edges:
            at = np.flatnonzero(on)
            src = np.repeat(np.arange(n, dtype=np.int32), np.diff(ptr))[at]
            out = pd.DataFrame({"i": np.minimum(src, dst[at]), "j": np.maximum(src, dst[at]), "b": on[at]})
        else:
            at = np.flatnonzero(total)
            out = pd.DataFrame({"i": at, "j": at, "b": total[at]})
        for k in range(0, len(out), 1 << 16):
            yield out[k : k + (1 << 16)]

    return run


def surprising(ranks: DataFrame, degree: DataFrame, top: int = 20) -> DataFrame:
    """The top nodes, marked if they lie between many (over 0.05) though linked to few (under 10)."""
    best = ranks.orderBy(F.desc("betweenness"), "id").limit(top)
    return best.join(degree, "id", "left").select("id", "betweenness", F.coalesce("degree", F.lit(0)).alias("degree"), ((F.col("betweenness") > 0.05) & (F.coalesce("degree", F.lit(0)) < 10)).alias("surprising"))


def cross_edges(community: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, cross): edges between two communities, a < b; the smaller sides are joined first."""
    u, v = (community.select(F.col("id").alias(x), F.col("community").alias(f"c{x}")) for x in "uv")
    return pairs.join(u, "u").join(v, "v").where("cu <> cv").groupBy(F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b")).agg(F.count(F.lit(1)).alias("cross"))


def top_members(community: DataFrame, pairs: DataFrame, most: int = 3) -> DataFrame:
    """(community, id, degree, nth) of each community's most connected members; ties go by id."""
    order = Window.partitionBy("community").orderBy(F.desc("degree"), "id")
    return community.join(degrees(pairs), "id").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select("community", "id", "degree", "nth")


def by_severity(gap: DataFrame) -> DataFrame:
    """Gaps without an edge first, then by the number of edges."""
    return gap.orderBy(F.col("severity") != "HIGH", "cross_edges", "a", "b")


def gaps(community: DataFrame, edge: DataFrame, least: int = MIN_COMMUNITY, most: int = MAX_CROSS) -> DataFrame:
    """Pairs of communities of at least so many nodes with few edges between: severity, cross edges, sizes, top members.

    The communities of that size are few beside the nodes; pairs without an edge are the point, so all
    pairs of these, and only these, are formed.
    """
    pairs = simple(edge)
    sizes = materialise(community.groupBy("community").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least), "sizes")
    cross = cross_edges(community, pairs)
    top = top_members(community, pairs).groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "id"))), lambda x: x["id"]), ", ").alias("top"))
    s1, s2 = sizes.select(F.col("community").alias("a"), F.col("size").alias("size_a")), sizes.select(F.col("community").alias("b"), F.col("size").alias("size_b"))
    out = s1.join(s2, F.col("a") < F.col("b")).join(cross, ["a", "b"], "left").withColumn("cross_edges", F.coalesce("cross", F.lit(0)))
    out = out.where(F.col("cross_edges") <= most).join(top.select(F.col("community").alias("a"), F.col("top").alias("top_a")), "a", "left").join(top.select(F.col("community").alias("b"), F.col("top").alias("top_b")), "b", "left")
    question = F.concat(F.lit("What links "), "top_a", F.lit(" with "), "top_b", F.lit("?"))
    return out.select("a", "b", "size_a", "size_b", "cross_edges", F.when(F.col("cross_edges") == 0, "HIGH").otherwise("MEDIUM").alias("severity"), question.alias("question"))


def modularity(community: DataFrame, edge: DataFrame) -> float:
    pairs = materialise(simple(edge), "mod")
    a, b = (community.select(F.col("id").alias(x), F.col("community").alias(f"c{x}")) for x in "uv")
    m = pairs.count()
    if not m:
        return 0.0
    inside = pairs.join(a, "u").join(b, "v").where("cu = cv").count()
    mass = community.join(degrees(pairs), "id").groupBy("community").agg(F.sum("degree").alias("d")).agg(F.sum((F.col("d") / (2 * m)) ** 2)).first()[0]
    return inside / m - (mass or 0.0)


def skeleton(edge: DataFrame, most: int = 200) -> DataFrame:
    """The edges with the highest edge betweenness; nodes all stay in the graph."""
    return betweenness(edge, edges=True).orderBy(F.desc("betweenness"), "u", "v").limit(most)


def homology(edge: DataFrame, most: int = 500, least: float = 0.5, top: int = 10) -> dict:
    """Persistent H0 and H1 of the shortest-path metric on the most connected nodes; unreachable is max + 1.

    Bounded by most nodes, so one process reduces the boundary matrix over two elements; a loop is
    kept if it lives longer than least.
    """
    pairs = simple(edge)
    best = [r["id"] for r in degrees(pairs).orderBy(F.desc("degree"), "id").limit(most).collect()]
    at = {x: i for i, x in enumerate(best)}
    # Only nodes that are chosen are gathered.
    ids = edge.sparkSession.createDataFrame([(x,) for x in best], "u string") if best else None
    rows = pairs.join(ids, "u", "left_semi").join(ids.withColumnRenamed("u", "v"), "v", "left_semi").collect() if best else []
    n = len(best)
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    near: list[list[int]] = [[] for _ in range(n)]
    for r in rows:
        near[at[r["u"]]].append(at[r["v"]])
        near[at[r["v"]]].append(at[r["u"]])
    for s in range(n):
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for v in near[u]:
                if d[s, v] == np.inf:
                    d[s, v] = d[s, u] + 1
                    queue.append(v)
    top_d = d[np.isfinite(d)].max() if n else 0
    d[~np.isfinite(d)] = top_d + 1
    order = sorted(((d[i, j], i, j) for i in range(n) for j in range(i + 1, n)))
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    h0, closing = [], set()
    for k, (w, i, j) in enumerate(order):
        a, b = find(i), find(j)
        if a != b:
            parent[a] = b
            h0.append(float(w))
        else:
            closing.add(k)
    # Loops: cohomology of the edges in falling order, each with its cofacets (triangles by longest edge).
    # An edge that joined two parts of H0 can't open a loop and is passed over.
    rank = np.zeros((n, n), np.int64)
    for k, (_, i, j) in enumerate(order):
        rank[i, j] = rank[j, i] = k
    h1, owner, kept = [], {}, {}

    def cofacets(k: int) -> set[tuple[int, int]]:
        _, i, j = order[k]
        far = np.maximum(np.maximum(rank[i], rank[j]), k)
        third = np.where(far == k, np.arange(n), np.where(far == rank[i], j, i))
        return {(int(f), int(m)) for x, (f, m) in enumerate(zip(far, third, strict=True)) if x not in (i, j)}

    for k in sorted(closing, reverse=True):
        _, i, j = order[k]
        # A triangle whose longest edge this is: only this edge can own it, and the loop lives no time.
        below = (rank[i] < k) & (rank[j] < k)
        below[[i, j]] = False
        if below.any():
            owner[k, int(np.flatnonzero(below)[0])] = k
            continue
        col = cofacets(k)
        while col and (low := min(col)) in owner:
            other = owner[low]
            if other not in kept:
                kept[other] = cofacets(other)
            col ^= kept[other]
        if col:
            low = min(col)
            owner[low], kept[k] = k, col
            if order[low[0]][0] - order[k][0] > least:
                h1.append((float(order[k][0]), float(order[low[0]][0])))
    return {"h0": h0, "h1": sorted(h1, key=lambda x: x[0] - x[1])[:top], "nodes": n}
