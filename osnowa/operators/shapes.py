"""Routing by rules, guarded merges, box joins and small text shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


def first_route(items: DataFrame, match: dict[str, tuple[str, str]], rules: list[tuple], fields: list[str]) -> DataFrame:
    """``items`` with the route of the first rule that fits; a rule's null field fits everything.

    Rules are (order, *fields, route); ``match`` says which item column a field is compared with, and whether it must be equal
    or begin with the field. The rules become one expression, no join.
    """
    out = None
    for rule in sorted(rules, key=lambda r: r[0]):
        cond = F.lit(True)
        for name, value in zip(fields, rule[1:-1]):
            if value is not None:
                column, how = match[name]
                cond = cond & F.coalesce(F.col(column).startswith(value) if how == "prefix" else F.col(column) == value, F.lit(False))
        out = F.when(cond, rule[-1]) if out is None else out.when(cond, rule[-1])
    routed = items.withColumn("route", F.lit(None).cast("string") if out is None else out)
    return routed.where("route IS NOT NULL")


def contains_any(column: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(column, F.lit(p))
    return F.coalesce(out, F.lit(False))


def merge_known(base: DataFrame, over: DataFrame, key: list[str], value: str) -> DataFrame:
    """All keys of both; the second's value where it is not null, else the first's."""
    b, o = base.select(*key, F.col(value).alias("_b")), over.select(*key, F.col(value).alias("_o"))
    return b.join(o, key, "full").select(*key, F.coalesce("_o", "_b").alias(value))


def within_box(boxes: DataFrame, blocks: DataFrame, dx: float, up: float, down: float) -> DataFrame:
    """Pairs of a box (x, y) and the blocks (x, y) within dx of its x, at most ``up`` above and ``down`` below its y.

    Both sides are put on a grid of cells as wide as the window, so the join is by equality and then checked.
    """
    h = up + down
    a = boxes.select(*[F.col(c).alias("_bx" if c == "x" else "_by" if c == "y" else c) for c in boxes.columns])
    a = a.withColumn("_cx", F.explode(F.sequence(F.floor((F.col("_bx") - dx) / (2 * dx)), F.floor((F.col("_bx") + dx) / (2 * dx)))))
    a = a.withColumn("_cy", F.explode(F.sequence(F.floor((F.col("_by") - up) / h), F.floor((F.col("_by") + down) / h))))
    b = blocks.withColumn("_cx", F.floor(F.col("x") / (2 * dx))).withColumn("_cy", F.floor(F.col("y") / h))
    near = F.col("x").between(F.col("_bx") - dx, F.col("_bx") + dx) & F.col("y").between(F.col("_by") - up, F.col("_by") + down)
    return a.join(b, ["_cx", "_cy"]).where(near).drop("_cx", "_cy", "_bx", "_by")


def counts_within_box(boxes: DataFrame, blocks: DataFrame, box: str, block: str, dx: float, up: float, down: float, most: int = 1 << 20) -> DataFrame:
    """(box, blocks, first_block): number and least of the blocks :func:`within_box` pairs with a box, which are not paired one by one.

    Blocks of one point are one row first. Where the boxes' x and the blocks' y make at most ``most`` combinations, points are
    summed up to those and then over y, else distinct points are paired on the grid. Boxes without blocks have no row.
    """
    total = (F.sum("n").alias("n"), F.min("least").alias("least"))
    points = blocks.where("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.min(block).alias("least"))
    points, boxes = cut(points), boxes.select(box, "x", "y").where("x IS NOT NULL AND y IS NOT NULL")
    at = boxes.select("x").distinct()
    if at.count() * points.select("y").distinct().count() <= most:
        cell = lambda x: F.floor(x / (dx / 4))
        a = at.select(F.col("x").alias("_bx"), F.explode(F.sequence(cell(F.col("x") - dx), cell(F.col("x") + dx))).alias("_c"))
        near = a.join(points.withColumn("_c", cell(F.col("x"))), "_c").where(F.col("x").between(F.col("_bx") - dx, F.col("_bx") + dx))
        strips = near.groupBy("_bx", F.col("y").alias("_y")).agg(*total)
        got = boxes.join(strips, F.col("x") == F.col("_bx")).where(F.col("_y").between(F.col("y") - up, F.col("y") + down))
    else:
        places = boxes.select("x", "y").distinct().withColumns({"_px": F.col("x"), "_py": F.col("y")})
        near = within_box(places, points, dx, up, down).groupBy("_px", "_py").agg(*total)
        got = boxes.join(near, (F.col("x") == F.col("_px")) & (F.col("y") == F.col("_py")))
    return got.groupBy(box).agg(F.sum("n").alias("blocks"), F.min("least").alias("first_block"))


def first_or_else(first: DataFrame, other: DataFrame) -> DataFrame:
    """The first frame if it has rows, else the other; decided within the plan, from a one-row count."""
    n = first.agg(F.count(F.lit(1)).alias("_n"))
    return first.unionByName(other.crossJoin(n).where("_n = 0").drop("_n"))


def caption(head: Column, parts: list[Column]) -> Column:
    """The head and every part that is not null and not in the head, joined by commas."""
    return F.concat_ws(", ", head, *[F.when(~F.contains(head, p), p) for p in parts])


def insert_after(text: Column, marker: str, block: str, end: str) -> Column:
    """The block after the first marker; without one the text with ``end``."""
    at = F.instr(text, marker)
    head = F.substring(text, F.lit(1), at + len(marker) - 1)
    tail = F.substring(text, at + len(marker), F.length(text))
    return F.when(at > 0, F.concat(head, F.lit(block), tail)).otherwise(F.concat(text, F.lit(end)))


def sentences(text: Column) -> Column:
    """Sentences of a text; an abbreviation of up to three small letters, or a capital
    and a small one, a single letter or a number before the stop ends none."""
    marked = F.regexp_replace(text, r"(?<![\p{L}\p{N}])(?:\p{L}|\p{Lu}\p{Ll}|\p{Ll}{1,3}|[0-9]{1,4})\.(?= )", "$0\u0002")
    parts = F.split(marked, r"(?<=[.!?…])\s+(?=\p{Lu})")
    return F.filter(F.transform(parts, lambda s: F.trim(F.replace(s, F.lit("\u0002"), F.lit("")))), lambda s: F.length(s) > 0)


def parse_specs(df: DataFrame, column: str) -> DataFrame:
    """(name, track, vs, dataset, run) of texts like ``NAME=TRACK:VS:ds=run,run;ds=run``; an empty VS is null."""
    p = df.select(F.substring_index(column, "=", 1).alias("name"), F.expr(f"substring({column}, instr({column}, '=') + 1)").alias("rest"))
    part = lambda i: F.split_part("rest", F.lit(":"), F.lit(i))
    d = p.select("name", part(1).alias("track"), F.nullif(part(2), F.lit("")).alias("vs"), F.explode(F.split(part(3), ";")).alias("d"))
    d = d.select("name", "track", "vs", F.split_part("d", F.lit("="), F.lit(1)).alias("dataset"), F.split_part("d", F.lit("="), F.lit(2)).alias("runs"))
    return d.select("name", "track", "vs", "dataset", F.explode(F.split("runs", ",")).alias("run"))


def fill_deficits(wanted: dict[str, int], have: dict[str, int], free: int) -> dict[str, int]:
    """``free`` units given one by one to the category furthest below its target in proportion; ties go to the first in key
    order. Categories are few: this is planning, not data."""
    out = {k: 0 for k in wanted}
    for _ in range(free):
        short = {k: (wanted[k] - have.get(k, 0) - out[k]) / wanted[k] for k in wanted if wanted[k] > 0}
        if not short or max(short.values()) <= 0:
            break
        out[min(short, key=lambda k: (-short[k], k))] += 1
    return out


__all__ = ["first_route", "contains_any", "merge_known", "within_box", "counts_within_box", "first_or_else", "caption", "insert_after", "sentences", "parse_specs", "fill_deficits"]
