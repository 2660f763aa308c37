"""The two most frequent neighbour colours against a plain count, over bands, gaps and images of one line."""

import random

import pytest

from weftline.operators import stencil


@pytest.mark.parametrize("step", [7, 1 << 16])
def test_top_two_as_counted_one_by_one(spark, step, monkeypatch):
    draw = random.Random(3)
    # one image has pixels missing, one more lines than a band
    places = {1: [(x, y) for x in range(9) for y in range(7) if draw.random() < 0.7], 2: [(x, 0) for x in range(5)], 3: [(x, y) for x in range(3) for y in range(stencil.BAND + 5)], 4: [(3, 3)]}
    c = {(i, x, y): draw.choice([5, 6, 7, (1 << 32) - 1]) for i, ps in places.items() for x, y in ps}
    rows = [(*k, v) for k, v in c.items()]
    draw.shuffle(rows)
    want = {}
    for (i, x, y), own in c.items():
        seen = [c[i, x + dx, y + dy] for dx, dy in stencil.OFFSETS if (i, x + dx, y + dy) in c]
        best = sorted(dict.fromkeys(seen), key=lambda k: (-seen.count(k), seen.index(k)))
        if best:
            want[i, x, y] = (own, best[0], best[1] if len(best) > 1 else None, len(best))
    monkeypatch.setattr(stencil, "STEP", step)
    found = stencil.top_two(spark.createDataFrame(rows, "image_id long, x int, y int, c long"))
    assert {(r.image_id, r.x, r.y): (r.c, r.c1, r.c2, r.n_unique) for r in found.collect()} == want


def test_neighbours_are_sorted_once(spark):
    df = stencil.top_two(spark.createDataFrame([(1, 0, 0, 5)], "image_id long, x int, y int, c long"))
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    assert sum("Sort [" in x for x in lines) == 1 and not any("Window" in x for x in lines)
