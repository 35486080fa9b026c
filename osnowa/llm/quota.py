"""Samples that match target category proportions, by min-cost flow over cross-classified counts.

The records are counted by cell, one category of each dimension; the cells, never the records, go to the driver, and there are
at most as many as combinations of target categories. Flow runs from the first dimension through the second to the third: arcs
into a category carry its target share with a floor, arcs between categories are limited by what the cells hold, and a slack arc
beside each category takes, at a high cost, what cannot be met. Within each middle category a second flow turns the arc totals
into cell quotas. The quotas are then drawn from each cell in a seeded random order.

Which categories cannot be met whatever else is asked for is read from the slack arcs of a second network, in which every
category sends what it needs to the cells that carry it, and what they cannot take over its slack arc (:func:`shortfalls`).
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from decimal import ROUND_CEILING, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.names import canonical
from ..session import cut
from .sketch import few

class Flow:
    """Min-cost flow by successive shortest paths with potentials; capacities are integers, costs are not negative."""

    def __init__(self) -> None:
        self.head: dict = defaultdict(list)
        self.arcs: list[list] = []  # to, capacity, cost

    def arc(self, a, b, capacity: int, cost: int) -> int:
        self.head[a].append(len(self.arcs))
        self.arcs.append([b, int(capacity), cost])
        self.head[b].append(len(self.arcs))
        self.arcs.append([a, 0, -cost])
        return len(self.arcs) - 2

    def used(self, arc: int) -> int:
        return self.arcs[arc ^ 1][1]

    def run(self, source, sink, amount: int) -> int:
        potential: dict = defaultdict(int)
        sent = 0
        while sent < amount:
            dist, via, queue, n = {source: 0}, {}, [(0, 0, source)], 0
            done = set()
            while queue:
                d, _, u = heapq.heappop(queue)
                if u in done:
                    continue
                done.add(u)
                for k in self.head[u]:
                    v, cap, cost = self.arcs[k]
                    if cap > 0 and v not in done:
                        nd = d + cost + potential[u] - potential[v]
                        if nd < dist.get(v, 1 << 60):
                            dist[v], via[v] = nd, k
                            n += 1
                            heapq.heappush(queue, (nd, n, v))
            if sink not in dist:
                break
            far = dist[sink]
            for u in self.head:
                potential[u] += min(dist.get(u, far), far)
            step, u = amount - sent, sink
            while u != source:
                step = min(step, self.arcs[via[u]][1])
                u = self.arcs[via[u] ^ 1][0]
            u = sink
            while u != source:
                self.arcs[via[u]][1] -= step
                self.arcs[via[u] ^ 1][1] += step
                u = self.arcs[via[u] ^ 1][0]
            sent += step
        return sent


def apportion(shares: dict, size: int, floors: dict) -> dict:
    """Whole-number targets summing to ``size`` by largest remainder, floors first; ties go to the first in key order.

    Floors that exceed ``size`` together are scaled down by taking from the largest target until the sum fits or all are 0.
    """
    total = sum(shares.values()) or 1
    raw = {k: size * v / total for k, v in shares.items()}
    out = {k: int(x) for k, x in raw.items()}
    for k in sorted(raw, key=lambda k: (-(raw[k] - int(raw[k])), k))[: size - sum(out.values())]:
        out[k] += 1
    for k in out:
        out[k] = max(out[k], floors.get(k, 0))
    while sum(out.values()) > size:
        spare = [k for k in out if out[k] > floors.get(k, 0)] or [k for k in out if out[k] > 0]
        if not spare:
            break
        out[max(spare, key=lambda k: (out[k] - floors.get(k, 0), k))] -= 1
    return out


_MISS = 1000  # cost of a record that misses a category's target


def plan(cells: dict[tuple, int], targets: list[dict], floors: list[dict], size: int) -> tuple[dict, list[dict]]:
    """Quotas of the cells (tuples of one, two or three categories) and, per dimension, what each category ends up with.

    A null category of a cell is None and belongs to no target: such a cell is used only where nothing else is left to fill
    the size. All targets are met that can be met together along the chain of dimensions; misses cost alike everywhere.
    """
    dims = len(targets)
    goal = [apportion(t, size, f) for t, f in zip(targets, floors)]
    middle = dims // 2  # the dimension whose categories the second flow works in
    order = [0] if dims == 1 else ([0, 1] if dims == 2 else [0, middle, 2])
    pair: list[dict] = [defaultdict(int) for _ in range(max(dims - 1, 1))]
    node_cap: list[dict] = [defaultdict(int) for _ in range(dims)]
    for cell, n in cells.items():
        for i, d in enumerate(order):
            node_cap[i][cell[d]] += n
        for i in range(len(order) - 1):
            pair[i][(cell[order[i]], cell[order[i + 1]])] += n

    net = Flow()

    def through(i: int, c, a, b) -> None:
        """Arcs of category c of the i-th dimension in order: up to its target free, beyond it at a cost."""
        want = min(goal[order[i]].get(c, 0), node_cap[i][c])
        floor = min(floors[order[i]].get(c, 0), want)
        if want > floor:
            net.arc(a, b, want - floor, _MISS)
        if floor:
            net.arc(a, b, floor, 0)  # floors first
        net.arc(a, b, node_cap[i][c] - want, 3 * _MISS)

    for i in range(dims):
        for c in node_cap[i]:
            through(i, c, ("in", i, c), ("out", i, c))
            if i == 0:
                net.arc("source", ("in", 0, c), node_cap[0][c], 0)
            if i == dims - 1:
                net.arc(("out", i, c), "sink", node_cap[i][c], 0)
    arcs = [{k: net.arc(("out", i, k[0]), ("in", i + 1, k[1]), n, 0) for k, n in pair[i].items()} for i in range(dims - 1)]
    net.run("source", "sink", min(size, sum(cells.values())))
    sent = [{k: net.used(a) for k, a in layer.items()} for layer in arcs]

    quota: dict = {}
    if dims == 1:
        for cell in cells:
            quota[cell] = sum(net.used(k) for k in net.head[("in", 0, cell[0])] if k % 2 == 0 and net.arcs[k][0] == ("out", 0, cell[0]))
    elif dims == 2:
        quota = {(a, b): n for (a, b), n in sent[0].items()}
    else:
        for m in node_cap[1]:
            inner, keys = Flow(), {}
            left = {a: n for (a, x), n in sent[0].items() if x == m and n}
            right = {b: n for (x, b), n in sent[1].items() if x == m and n}
            for a, n in left.items():
                inner.arc("s", ("l", a), n, 0)
                inner.arc("s", ("l", a), size, 2 * _MISS)  # slack: the other side's margin cannot be met in this category
            for b, n in right.items():
                inner.arc(("r", b), "t", n, 0)
                inner.arc(("r", b), "t", size, 2 * _MISS)
            for cell, n in cells.items():
                if cell[middle] == m:
                    if cell[0] not in left:
                        inner.arc("s", ("l", cell[0]), size, 3 * _MISS)
                    if cell[2] not in right:
                        inner.arc(("r", cell[2]), "t", size, 3 * _MISS)
                    keys[cell] = inner.arc(("l", cell[0]), ("r", cell[2]), n, 0)
            inner.run("s", "t", sum(left.values()))
            quota |= {cell: inner.used(k) for cell, k in keys.items()}
    got: list[dict] = [defaultdict(int) for _ in range(dims)]
    for cell, n in quota.items():
        for d in range(dims):
            got[d][cell[d]] += n
    return {c: n for c, n in quota.items() if n}, got


def whole(share, size: int) -> int:
    """The least whole number not below share x size, the share taken as it is written in decimals."""
    return int((Decimal(repr(float(share or 0))) * size).to_integral_value(ROUND_CEILING))


def shortfalls(carried: dict, need: dict, slack: bool = True) -> dict:
    """What each category lacks, read from the slack arcs of a min-cost flow.

    ``carried``: of each category the cells whose keys carry it, with their counts; ``need``: how many keys each category asks
    for. A category sends its need over an arc limited by its cells together, and the rest, at a cost, over its slack arc. Cells
    are not used up by categories of another dimension, so what is short is short in every sample. Without slack arcs nothing is.
    """
    net, spare = Flow(), {}
    for c, wanted in need.items():
        net.arc("source", ("category", c), wanted, 0)
        net.arc(("category", c), "sink", sum(carried.get(c, {}).values()), 0)
        if slack:
            spare[c] = net.arc(("category", c), "sink", wanted, _MISS)
    net.run("source", "sink", sum(need.values()))
    return {c: net.used(spare[c]) if slack else 0 for c in need}


def quota_sample(
    records: DataFrame, key: str, dims: list[str], targets: DataFrame, part: int = 5, seed: int = 11, salts: int = 32
) -> tuple[DataFrame, DataFrame]:
    """A sample of floor(distinct keys / part) keys matching ``targets`` (dim, category, share, min_rows), and a report.

    Sample: key and the canonical category of each dimension. Report: dim, category, available (distinct keys that carry the
    category in any spelling in any of their rows), wanted (the larger of share x size, rounded up, and min_rows), drawn, short
    (flow over the category's slack arc). A key with several rows takes part with its least value per dimension. Null and blank
    keys are left out, null or unknown categories fit no target. An empty table gives an empty sample and a report of shortfalls.
    """
    spark = records.sparkSession
    wanted = [r.asDict() for r in targets.where("dim IS NOT NULL AND category IS NOT NULL").transform(lambda t: few(t.select("dim", "category", "share", "min_rows"))).collect()]
    named = [[r["category"] for r in wanted if r["dim"] == d] for d in dims]
    slim = records.where(F.length(F.trim(F.col(key).cast("string"))) > 0).select(
        F.col(key).alias("key"), *[canonical(F.col(d), c).alias(f"d{i}") for i, (d, c) in enumerate(zip(dims, named))]
    )
    cols = [f"d{i}" for i in range(len(dims))]
    # one row per key: its categories; a set holds at most the target categories
    one = cut(slim.groupBy("key").agg(*[F.min(c).alias(c) for c in cols], *[F.collect_set(c).alias(f"s{c}") for c in cols]))
    cells = {tuple(r[c] for c in cols): r["n"] for r in one.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).collect()}
    size = sum(cells.values()) // part
    carried: dict[tuple, dict] = {(r["dim"], r["category"]): {} for r in wanted if r["dim"] in dims}
    for i, c in enumerate(cols):  # at most categories x cells rows
        for r in one.select(F.explode(f"s{c}").alias("category"), *cols).groupBy("category", *cols).agg(F.count(F.lit(1)).alias("n")).collect():
            carried[(dims[i], r["category"])][tuple(r[x] for x in cols)] = r["n"]
    share = [{r["category"]: float(r["share"] or 0) for r in wanted if r["dim"] == d} for d in dims]
    floor = [{r["category"]: int(r["min_rows"] or 0) for r in wanted if r["dim"] == d} for d in dims]
    need = {
        (r["dim"], r["category"]): max(whole(r["share"], size), int(r["min_rows"] or 0)) for r in wanted if r["dim"] in dims
    }
    short = shortfalls(carried, need)
    quota, got = plan(cells, share, floor, size)
    rows = [
        (d, c, sum(carried[(d, c)].values()), need[(d, c)], got[i].get(c, 0), short[(d, c)])
        for i, d in enumerate(dims) for c in dict.fromkeys(named[i])
    ]
    report = spark.createDataFrame(rows, "dim string, category string, available bigint, wanted bigint, drawn bigint, short bigint")
    quotas = spark.createDataFrame([(*c, n) for c, n in quota.items()], ", ".join(f"{c} string" for c in cols) + ", quota bigint")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in cols]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    order = F.xxhash64(F.lit(seed), F.col("key"))
    # the first ``quota`` of a cell in hash order: first within salted parts of the cell, then over what they leave
    joined = one.alias("a").join(F.broadcast(quotas.alias("b")), cond).select("key", *[F.col(f"a.{c}").alias(c) for c in cols], "quota")
    joined = joined.withColumn("h", order).withColumn("salt", F.pmod(F.hash("key"), F.lit(salts)))
    near = Window.partitionBy(*cols, "salt").orderBy("h", "key")
    all_ = Window.partitionBy(*cols).orderBy("h", "key")
    drawn = (
        joined.withColumn("r", F.row_number().over(near)).where("r <= quota")
        .withColumn("r", F.row_number().over(all_)).where("r <= quota")
    )
    return drawn.select(F.col("key").alias(key), *[F.col(c).alias(d) for c, d in zip(cols, dims)]), report
