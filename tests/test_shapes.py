"""Counts in boxes against a loop, on both ways; blocks of one point are paired once."""

import random

import pytest

from osnowa.operators import shapes


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_counts_within_box(spark, monkeypatch, most):
    r = random.Random(3)
    spot = lambda: float(r.choice([r.randrange(-40, 40), r.random() * 40]))
    boxes = [(i, None if i == 7 else spot(), spot()) for i in range(60)]
    blocks = [(i, spot(), None if i == 5 else spot()) for i in range(150)] + [(200 + i, 3.0, 4.0) for i in range(500)]
    rows = lambda name, d: spark.createDataFrame(d, f"{name} bigint, x double, y double")
    seen = []
    within = shapes.within_box
    monkeypatch.setattr(shapes, "within_box", lambda a, b, *x: seen.append(b.count()) or within(a, b, *x))
    got = {(x["box"], x["blocks"], x["first_block"]) for x in shapes.counts_within_box(rows("box", boxes), rows("block", blocks), "box", "block", 8, 5, 3, most).collect()}
    want = set()
    for k, x, y in boxes:
        near = [b for b, u, v in blocks if x is not None and v is not None and x - 8 <= u <= x + 8 and y - 5 <= v <= y + 3]
        if near:
            want.add((k, len(near), min(near)))
    assert got == want and all(n < 160 for n in seen) and len(seen) == (most == 0)
