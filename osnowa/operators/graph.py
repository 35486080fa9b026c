"""Graph operators: closure, bounded search, inheritance, merging of boxes."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None = None, most: int | None = None) -> DataFrame:
    """(node, depth): nodes reachable from the seeds (node) over edges (src, dst), with the fewest steps; in at most ``depth``
    steps if that is given, else until no node is new.

    ``most`` caps the out-edges followed per node, least dst first. Every round joins the new frontier only and is written out.
    """
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    if most:
        from .windows import top_k

        e = top_k(e, ["src"], [F.col("dst")], most).select("src", "dst")
    e = cut(e)
    seen = cut(seeds.select("node").where("node IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for d in itertools.count(1):
        if depth is not None and d > depth:
            break
        nxt = front.select(F.col("node").alias("src")).join(e, "src").select(F.col("dst").alias("node")).distinct()
        front = cut(nxt.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)))
        if not front.take(1):
            break
        seen = cut(seen.union(front)) if d % 16 == 0 else seen.union(front)
    return seen


def merge_closure(kept: DataFrame, merges: DataFrame) -> DataFrame:
    """(token): kept tokens and, transitively, both parts of every merge (left_part, right_part) that makes a needed token."""
    m = merges.select(F.concat("left_part", "right_part").alias("token"), "left_part", "right_part")
    down = m.select(F.col("token").alias("src"), F.explode(F.array("left_part", "right_part")).alias("dst"))
    return reach(down, kept.select(F.col("token").alias("node"))).select(F.col("node").alias("token"))


def new_ids(tokens: DataFrame, old_id: str) -> DataFrame:
    """Tokens with ids from 0 in the order of their old ids."""
    from .windows import in_order

    return in_order(tokens, [old_id]).withColumn("new_id", F.col("position") - 1).drop("position", "before")


def ancestors(parent: DataFrame) -> DataFrame:
    """(node, ancestor, distance) along single parents (node, parent), the node itself at 0, to the end of every chain.

    Known stretches are doubled in each round, so a chain of n takes log n of them. Nodes of a cycle, and those above which one
    stands, get each ancestor once, at its least distance.
    """
    p = cut(parent.where("parent IS NOT NULL AND node <> parent").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).distinct())
    out, known = p, p.count()
    while known:
        up = out.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("above"), F.col("distance").alias("more"))
        far = out.join(up, "ancestor").where("node <> above").select("node", F.col("above").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
        out = cut(out.union(far).groupBy("node", "ancestor").agg(F.min("distance").alias("distance")))
        if out.count() == known:
            break
        known = out.count()
    return parent.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance")).where("node IS NOT NULL").distinct().union(out)


def merge_boxes(boxes: DataFrame, page: list[str], slack: float = 6.0) -> DataFrame:
    """Boxes (x0, y0, x1, y1) of a page that overlap within ``slack`` become their bounding box, until none overlap.

    A page's boxes are few; they are merged in one group. Columns: page columns, x0, y0, x1, y1.
    """

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        todo = [list(map(float, b)) for b in pdf[["x0", "y0", "x1", "y1"]].sort_values(["y0", "x0", "x1", "y1"]).to_numpy()]
        changed = True
        while changed:
            changed, out = False, []
            for b in todo:
                for o in out:
                    if b[0] <= o[2] + slack and o[0] <= b[2] + slack and b[1] <= o[3] + slack and o[1] <= b[3] + slack:
                        o[:] = [min(o[0], b[0]), min(o[1], b[1]), max(o[2], b[2]), max(o[3], b[3])]
                        changed = True
                        break
                else:
                    out.append(b)
            todo = out
        got = pd.DataFrame(todo, columns=["x0", "y0", "x1", "y1"])
        for c in page:
            got[c] = pdf[c].iloc[0]
        return got[[*page, "x0", "y0", "x1", "y1"]]

    kinds = ", ".join(f"{c} {boxes.schema[c].dataType.simpleString()}" for c in page)
    return boxes.groupBy(*page).applyInPandas(merge, f"{kinds}, x0 double, y0 double, x1 double, y1 double")
