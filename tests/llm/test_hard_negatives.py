"""Hard negatives against a comparison of all pairs."""

import math
import random

import pytest

from weftline.llm import hard_negatives

DDL = "vec_id long, embedding array<float>, label int, id string, bucket string, score string"
rng = random.Random(5)


def rows(n=900, d=8):
    out = []
    for i in range(n):
        size = math.exp(rng.gauss(0, 1))  # norms of all sizes, so that bounds prune
        v = [rng.gauss(0.2, 1) * size for _ in range(d)]
        out.append((i, v, rng.choice([0, 1, 1, 1, 2, 3, 9])))
    hot = [round(rng.gauss(0, 1), 2) for _ in range(d)]
    out += [(n + i, hot, 1 + i % 2) for i in range(150)]  # ties of norm and score
    out += [(5000, None, 1), (5050, [1.0] * d, None), (5100, [float("nan")] * d, 1), (5150, [float("inf")] + [0.0] * (d - 1), 1), (None, [1.0] * d, 1)]
    out += [(5200, [None] + [1.0] * (d - 1), 1), (5250, [0.0] * d, 1), (5300, [1.0, 2.0], 2), (5301, [2.0, 2.0], 2), (5302, [1.0, 1.5], 3), (5350, [], 1), (5351, [], 1), (5352, [], 2), (5400, [-5.0] * d, 77)]
    return [(i, v if v is None else [None if x is None else struct_float(x) for x in v], l) for i, v, l in out]


def struct_float(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def brute(data, longest=hard_negatives.LONGEST):
    usable = {}
    for i, v, label in data:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        usable[i] = (label, [math.floor(256 * x) for x in v])
    out = set()
    for a in (i for i in usable if i % 50 == 0):
        label, v = usable[a]
        score = {i: max(-longest, min(longest, sum(x * y for x, y in zip(v, w)))) for i, (_, w) in usable.items() if i != a and len(w) == len(v)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if usable[i][0] == label][:5]:
            found = [i for i in order if usable[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:3]
            out |= {(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(found)}
    return out


@pytest.mark.parametrize("bucket", [4096, 60])
def test_all_pairs(spark, bucket):
    data = rows()
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in data], DDL)
    got = [tuple(r) for r in hard_negatives.mine(hard_negatives.relabelled(table), bucket=bucket).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data) and len(got) > 100


def test_repeated_rows_and_nothing(spark):
    data = rows(200)
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in [*data, *data[:120]]], DDL)
    got = [tuple(r) for r in hard_negatives.mine(hard_negatives.relabelled(table), bucket=50).collect()]
    assert set(got) == brute(data) and len(got) == len(set(got))
    assert hard_negatives.mine(hard_negatives.relabelled(table.limit(0))).count() == 0
    assert hard_negatives.mine(hard_negatives.relabelled(table.filter("vec_id % 50 <> 0"))).count() == 0


def test_numbers_beyond_exact_doubles(spark):
    """Scores that doubles don't hold exactly, and scores beyond 64 bits."""
    data = [(i, [1e6 * rng.random() for _ in range(6)], rng.choice([1, 2])) for i in range(300)]
    data += [(350, [1e12, 1.0], 1), (351, [1e12, 2.0], 1), (352, [1e12, 1.0], 2), (353, [9e11, 5.0], 2), (400, [1e300, 1.0], 1), (401, [1e303, 1.0], 1), (402, [1e200, 3.0], 2)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = {tuple(r) for r in hard_negatives.mine(hard_negatives.relabelled(table), bucket=40).collect()}
    assert got == brute(data)


def test_blocks_are_passed_over():
    """A window's bound stops the pass at the first block whose norms can't reach it."""
    import numpy as np
    import pyarrow as pa

    x = np.array([[100.0, 0.0], [1.0, 0.0], [0.1, 0.0]], "<f4")
    held = pa.RecordBatch.from_pydict({"id": pa.array([1, 2, 3]), "label": pa.array([2, 2, 2]), "vector": pa.array([r.tobytes() for r in x], pa.binary())})
    blocks = [(b[0][i : i + 1], b[1][i : i + 1], b[2][i : i + 1], float(hard_negatives.norms(b[0][i : i + 1])[0])) for b in hard_negatives._blocks([held], "<f4") for i in range(3)]
    seen = []
    inner = hard_negatives.inner_products
    hard_negatives.inner_products = lambda a, b: seen.append(len(b)) or inner(a, b)
    try:
        anchor = pa.RecordBatch.from_pydict({"id": pa.array([50]), "label": pa.array([1]), "vector": pa.array([np.array([1.0, 0.0], "<f4").tobytes()], pa.binary()), "wins": pa.array([[7]]), "lows": pa.array([[256 * 200]]), "highs": pa.array([[1 << 40]])})
        assert [r[3] for r in hard_negatives._pass(anchor, blocks, 3, False, "<f4")] == [1, 2]
    finally:
        hard_negatives.inner_products = inner
    assert len(seen) == 2
