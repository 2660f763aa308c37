"""Word shards of the n-gram model follow the size of the texts, and scores don't depend on their number."""

import numpy as np

from pyspark.sql import functions as F

from weftline.llm import kneser_ney, language_mixture


def test_scores_do_not_depend_on_shards(spark, monkeypatch):
    words = np.random.default_rng(4).zipf(1.6, 6000) % 900
    rows = [(i, " ".join(f"w{w}" for w in words[i * 20 : (i + 1) * 20])) for i in range(300)]
    docs = spark.createDataFrame([*rows, (300, None), (301, "")], "doc_id long, text string")
    score = lambda: sorted(tuple(r) for r in kneser_ney.score_texts(docs, language_mixture.held_out(7)).collect())
    few = score()
    held = docs.filter(~language_mixture.held_out(7))
    assert len(kneser_ney.train(held).arrays.sizes) == 4
    monkeypatch.setattr(kneser_ney, "SHARD_TEXT", 1500)
    many = kneser_ney.train(held)
    size = held.agg(F.sum(F.octet_length("text"))).first()[0]
    assert len(many.arrays.sizes) == -(-size // 1500) > 4 and many.docs == held.count()
    got = score()
    assert [r[:5] for r in got] == [r[:5] for r in few] and np.allclose([r[5:] for r in got], [r[5:] for r in few])
