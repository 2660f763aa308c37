"""Repeats in documents that are taken in several pieces."""

import hashlib
import random
from collections import Counter

import numpy as np

from weftline.llm import repeats

L = repeats.LENGTH


def brute_force(data):
    seen = Counter(hash(b[s : s + L]) for _, t in data for b in [t.encode()] for s in range(len(b) - L + 1))
    for i, t in data:
        raw = t.encode()
        mask, end = np.zeros(len(raw) + 1, np.int8), 0
        for s in range(len(raw) - L + 1):
            if seen[hash(raw[s : s + L])] > 1:
                mask[max(s, end) : s + L] = 1
                end = s + L
        kept = np.frombuffer(raw, np.uint8)[mask[:-1] == 0].tobytes()
        yield i, len(raw), int(mask.sum()), int((np.diff(mask) == -1).sum()), hashlib.sha256(kept).hexdigest()


def test_long_documents(spark):
    gen = random.Random(6)
    text = lambda n: "".join(gen.choices("abcdefgh ", k=n))
    step, shared = repeats.STEP, text(1000)
    # unique text over each border of pieces in the first, repeated text over them in the second
    across = text(step - 300) + shared + text(step - 700) + shared[:450] + text(400)
    data = [(0, text(2 * step + 900)), (1, across), (2, text(700) + shared[200:800])]
    # each place of a document in pieces is emitted once, as if the document were whole
    for _, t in data[:2]:
        raw = np.frombuffer(t.encode(), np.uint8)
        pos = np.concatenate([a["pos"] for a in repeats.anchors(raw, np.array([0, len(raw)]))])
        assert len(pos) == len(np.unique(pos)) and pos.max() + L > len(raw) - L
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(tuple(r)[:5] for r in repeats.remove_repeats(df).collect()) == sorted(brute_force(data))
