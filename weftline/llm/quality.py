"""Quality rules and an isolation forest over their statistics.

One pass over the texts yields the statistics. Forests of random splits are grown on a bounded sample of labelled
documents that pass the base rules: one over all statistics and one over each, since a statistic that good documents
also vary in would hide the others in a common forest. The mean path length of a document turns into an anomaly score
in (0, 1); for each forest the score from which a document is dropped is calibrated on the labels of that sample.

Defined results: null and empty texts have all statistics 0 and fail the base rules; without labelled rows of both
kinds the forest drops nothing; a score equal to its limit is kept; a text of any length is counted whole, its words as
numbers; repeated rows give repeated results, and of rows that repeat a labelled doc_id the one with the least statistics
is learned from; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Labelled documents that the forest and its threshold are fitted on, at most.
MAX_LABELLED = 20_000
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = "#*$%&|<>"


def repeated_words(words: list[str]) -> int:
    """Words in windows of three that occur twice or more, each word once; words are compared as numbers."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(number) + ids[1:]
    pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)  # numbers of pairs, below n
    _, place, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = count[place] > 1
    if not again.any():
        return 0
    held = np.zeros(n, bool)
    for j in range(3):
        held[j : n - 2 + j] |= again
    return int(held.sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The statistics of one whole text, in the order of STATS."""
    if not text:
        return (0, 0, 0, 0, 0, 0)
    words = _WORD.findall(text)
    n = len(words)
    symbols = sum(map(text.count, _SYMBOLS))
    seen, dup, lines = set(), 0, text.split("\n")
    for line in lines:
        if line in seen:
            dup += bool(_WORD.search(line))
        else:
            seen.add(line)
    repeat = repeated_words(words)
    return n, sum(map(len, words)), symbols, dup, repeat, len(lines)


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < 50) | (100 * stats[:, 4] > 50 * stats[:, 0])


def features(stats: np.ndarray) -> np.ndarray:
    """What the forest splits on: word length and the shares of symbols, repeated lines and repeated words."""
    n = np.maximum(stats[:, 0], 1).astype(float)
    return np.stack([stats[:, 1] / n, stats[:, 2] / n, stats[:, 3] / np.maximum(stats[:, 5], 1), stats[:, 4] / n], axis=1)


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n leaves."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees as flat arrays: split feature (-1 for a leaf), split value, left and right child, path length at a leaf."""

    def __init__(self, rows: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.sample = min(sample, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(self.sample, 2)))))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.sample, replace=False)], rng) for _ in range(trees)]

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        nodes: list[list[float]] = []

        def node(part: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, 0, 0, depth + float(mean_path(len(part)))])
            low, high = part.min(axis=0), part.max(axis=0)
            free = np.flatnonzero(high > low)
            if depth < self.depth and len(part) > 1 and len(free):
                f = int(rng.choice(free))
                value = float(rng.uniform(low[f], high[f]))
                left = part[:, f] <= value
                nodes[at][:4] = [f, value, node(part[left], depth + 1), node(part[~left], depth + 1)]
            return at

        node(rows, 0)
        flat = np.array(nodes)
        return flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path length / its expectation); larger is more anomalous."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, value, left, right, length in self.trees:
            at = np.zeros(len(rows), int)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, np.where(rows[every, np.maximum(f, 0)] <= value[at], left[at], right[at]))
            total += length[at]
        return np.exp2(-total / len(self.trees) / max(float(mean_path(self.sample)), 1e-9))


def calibrate(scores: np.ndarray, bad: np.ndarray, max_false: float = 0.002) -> float:
    """The score from which to drop: most bad rows dropped less good rows dropped, with at most max_false of the good
    and a tenth of the share of bad rows."""
    order = np.argsort(-scores, kind="stable")
    s, b = scores[order], bad[order]
    hit, false = np.cumsum(b) / max(b.sum(), 1), np.cumsum(~b) / max((~b).sum(), 1)
    ends = np.append(s[1:] < s[:-1], True)
    gain = np.where(ends & (false <= max_false) & (hit >= 10 * false), hit - false, -1.0)
    best = int(np.argmax(gain)) if len(gain) else 0
    if not len(gain) or gain[best] <= 0:
        return float("inf")
    return float((s[best] + s[best + 1]) / 2) if best + 1 < len(s) else float(s[best])


class Forests:
    """The joint forest, then one for each statistic, with their calibrated limits."""

    def __init__(self, rows: np.ndarray, bad: np.ndarray, max_false: float = 0.005):
        self.views = [list(range(rows.shape[1])), *([i] for i in range(rows.shape[1]))]
        self.forests = [IsolationForest(rows[:, v], seed=7 + k) for k, v in enumerate(self.views)]
        self.limits = np.array([calibrate(s, bad, max_false / len(self.views)) for s in self.scores(rows).T])

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([f.score(rows[:, v]) for f, v in zip(self.forests, self.views, strict=True)], axis=1)

    def dropped(self, scores: np.ndarray) -> np.ndarray:
        return (scores >= self.limits).any(axis=1)


def _stats_batches(batches: Iterator[pa.RecordBatch], keep: list[str], extra=None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stats = np.array([text_stats(x.as_py()) for x in batch.column("text")], np.int64).reshape(-1, len(STATS))
        columns = {c: batch.column(c) for c in keep} | {c: pa.array(stats[:, i]) for i, c in enumerate(STATS)}
        if extra is not None:
            columns |= extra(stats)
        yield pa.RecordBatch.from_pydict(columns)


_STATS_DDL = ", ".join(f"{c} long" for c in STATS)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> Forests | None:
    """Forests and limits from at most ``max_rows`` labelled documents, those of the smallest hashed ids."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    known = labels.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality is not null and doc_id is not null")
    chosen = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(max_rows)
    # at most max_rows pairs of numbers: small enough to broadcast by its bound
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    found = rows.mapInArrow(lambda it: _stats_batches(it, ["doc_id", "quality"]), f"doc_id {kind}, quality int, {_STATS_DDL}")
    once = found.groupBy("doc_id").agg(F.min(F.struct("quality", *STATS)).alias("least")).select("doc_id", "least.*")
    found = once.toPandas().sort_values("doc_id")
    stats = found[list(STATS)].to_numpy(np.int64).reshape(-1, len(STATS))
    passing = ~base_failed(stats)
    x, bad = features(stats[passing]), found["quality"].to_numpy()[passing] == 0
    return Forests(x, bad) if bad.any() and not bad.all() else None


def quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> DataFrame:
    """Statistics, base verdict, largest anomaly score and verdict of every document."""
    forests = fit(docs, labels, max_rows)

    def verdict(stats: np.ndarray) -> dict[str, pa.Array]:
        failed, zero = base_failed(stats), np.zeros((len(stats), 1))
        scores = zero if forests is None else forests.scores(features(stats))
        dropped = np.zeros(len(stats), bool) if forests is None else forests.dropped(scores)
        return {"base_failed": pa.array(failed), "anomaly": pa.array(scores.max(axis=1)), "kept": pa.array(~failed & ~dropped)}

    ddl = f"doc_id {dict(docs.dtypes)['doc_id']}, {_STATS_DDL}, base_failed boolean, anomaly double, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(lambda it: _stats_batches(it, ["doc_id"], verdict), ddl)
