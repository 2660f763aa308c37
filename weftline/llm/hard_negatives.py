"""Hard negatives by norm-bucketed inner-product search.

Candidates are sorted by norm over all partitions and cut into buckets of about BUCKET rows, largest norms first. A score is at most
the product of the two norms (Cauchy-Schwarz), so an anchor needs only the buckets whose largest norm can reach its bound:
the lower limit of its score window, or the score of its running kth. As buckets are in the order of norms those are the
first m of them, and m is looked up in a table of norm levels of a bounded size. A search has two rounds: each anchor visits the
first bucket, and, with the kth score from there as its bound, the others that can still matter. Within a bucket the
same test is made for blocks of rows, with the kth score as it is then.

There are two searches: positives (same label: buckets of that label; the first k) and, for each anchor and positive, the
first rows of other labels whose score lies in the window that the positive's score sets. Scores are exact whole numbers.
A bucket's candidates are held in a task, anchors stream past them in batches; candidates travel once in a search, anchors (1 in
50 rows) once for each bucket that they visit. A label or vector with a third of all rows is many buckets, since ties of
norms are cut by id. Best rows are limited by anchor before they are shuffled.

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part; of rows that repeat
an id the one with the least label and vector counts; vectors of different lengths are never compared; empty and zero
vectors score 0; scores beyond 64 bits count as the nearest long; ties go to the smaller id; an anchor
without positives or without negatives has no rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, write_table
from .turns import chunk, in_order

#: Rows of a bucket, rows of a block of it, and anchors or windows that pass at a time.
BUCKET, BLOCK, BATCH = 4096, 512, 512
#: Levels for each doubling of a norm: how finely bounds are looked up. Doubles have some 2100 doublings.
FINENESS = 64
#: Whole numbers up to here are exact in double precision.
EXACT = 1 << 53
LONGEST = (1 << 63) - 1


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 x) in double precision, which holds it exactly; beyond its range it is the largest double."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x.astype(np.float64) * 256), -np.finfo(np.float64).max, np.finfo(np.float64).max)


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of the rows; scaled first, so that no square overflows."""
    most = np.abs(x).max(axis=1, initial=0)
    safe = np.where(most > 0, most, 1)[:, None]
    with np.errstate(over="ignore"):
        return np.minimum(most * np.sqrt(((x / safe) ** 2).sum(axis=1)), np.finfo(np.float64).max)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of whole vectors as longs: by doubles where all their sums are exact, else by Python's integers."""
    with np.errstate(over="ignore"):
        bound = (np.abs(a).max(axis=0, initial=0) * np.abs(b).max(axis=0, initial=0)).sum()
    if bound < EXACT:
        return (a @ b.T).astype(np.int64)
    exact = [np.array([[int(v) for v in row] for row in m], dtype=object) for m in (a, b)]
    return np.clip(exact[0] @ exact[1].T, -LONGEST, LONGEST).astype(np.int64)


class Best:
    """For every window (low, high) the first k scores within it: the highest, of equal ones that of the least id."""

    def __init__(self, k: int, low: np.ndarray, high: np.ndarray):
        self.k, self.high = k, high
        self.kth = low.copy()  # what is below can't come in any more
        self.rows: list[list[tuple[int, int]]] = [[] for _ in low]

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Scores of the windows ``at`` (lines) with candidates ``ids`` (columns)."""
        fit = allowed & (scores >= self.kth[at][:, None]) & (scores <= self.high[at][:, None])
        many = np.flatnonzero(fit.sum(axis=1) > self.k)
        if len(many):  # only what reaches the kth of this block, ties included
            part = np.where(fit[many], scores[many], -LONGEST - 1)
            fit[many] &= scores[many] >= np.partition(part, -self.k, axis=1)[:, -self.k][:, None]
        lines, columns = np.nonzero(fit)
        if not len(lines):
            return
        own, their = scores[lines, columns], ids[columns]
        order = np.lexsort((their, -own, lines))
        lines, own, their = lines[order], own[order], their[order]
        first = np.flatnonzero(np.append(True, lines[1:] != lines[:-1]))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(lines)], strict=True):
            w, b = int(at[lines[a]]), min(b, a + self.k)
            kept = sorted([*self.rows[w], *zip(own[a:b].tolist(), their[a:b].tolist(), strict=True)], key=lambda r: (-r[0], r[1]))[: self.k]
            self.rows[w] = kept
            if len(kept) == self.k:
                self.kth[w] = max(self.kth[w], kept[-1][0])


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return whole(np.frombuffer(data, kind).reshape(len(column), -1)) if data else np.zeros((len(column), 0))


def _blocks(candidates: list[pa.RecordBatch], kind: str) -> list[tuple]:
    """A bucket's vectors, ids and labels in blocks by falling norm, with the largest norm of each."""
    c = pa.Table.from_batches(candidates).combine_chunks().to_batches()[0]
    x, ids, labels = _matrix(c.column("vector"), kind), c.column("id").to_numpy(), c.column("label").to_numpy()
    norm = norms(x)
    order = np.argsort(-norm, kind="stable")
    return [(x[p], ids[p], labels[p], norm[p[0]]) for p in (order[i : i + BLOCK] for i in range(0, len(order), BLOCK))]


def _pass(anchors: pa.RecordBatch, blocks: list[tuple], k: int, same: bool, kind: str) -> Iterator[tuple]:
    """(anchor, window, score, id): the first k of the bucket for each window of each anchor."""
    x, ids, labels = _matrix(anchors.column("vector"), kind), anchors.column("id").to_numpy(), anchors.column("label").to_numpy()
    wins, lows, highs = (anchors.column(c).combine_chunks() if isinstance(anchors.column(c), pa.ChunkedArray) else anchors.column(c) for c in ("wins", "lows", "highs"))
    owner = np.repeat(np.arange(len(ids)), [len(w) for w in wins])
    best = Best(k, lows.flatten().to_numpy().copy(), highs.flatten().to_numpy())
    norm = norms(x)
    for cx, cids, clabels, most in blocks:
        with np.errstate(over="ignore"):
            reach = norm[owner] * most * (1 + 1e-9)
        live = np.flatnonzero(reach >= best.kth)
        if not len(live):
            break  # the next blocks' norms are smaller still
        need, at = np.unique(owner[live], return_inverse=True)
        scores = inner_products(x[need], cx)
        allowed = (labels[need][:, None] == clabels[None, :]) == same
        allowed &= ids[need][:, None] != cids[None, :]
        for first in range(0, len(live), BATCH):
            part = slice(first, first + BATCH)
            best.add(live[part], scores[at[part]], cids, allowed[at[part]])
    names = wins.flatten().to_pylist()
    for w, rows in enumerate(best.rows):
        for score, i in rows:
            yield int(ids[owner[w]]), names[w], score, i


def _search(batches: Iterator[pa.RecordBatch], k: int, same: bool, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, candidates before anchors: a bucket's candidates are held, anchors pass."""
    out = pa.schema([("anchor", pa.int64()), ("win", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])
    bucket, held, blocks = None, [], []
    for batch in batches:
        key = np.stack([batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("dim", "part", "bucket", "is_anchor")], axis=1)
        cuts = (np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            if a == b:
                continue
            if (own := tuple(key[a, :3])) != bucket:
                bucket, held, blocks = own, [], []
            if not key[a, 3]:
                held.append(batch.slice(a, b - a))
                continue
            if held:
                blocks, held = _blocks(held, kind), []
            for i in range(a, b, BATCH):
                if rows := list(_pass(batch.slice(i, min(BATCH, b - i)), blocks, k, same, kind)):
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows, strict=True)], schema=out)


def usable(vectors: DataFrame) -> DataFrame:
    """id, label and embedding of the rows that take part, one for each id."""
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
    own = rows.select(F.col("vec_id").cast("long").alias("id"), F.struct(F.col("label").cast("long").alias("label"), "embedding").alias("v"))
    return own.groupBy("id").agg(F.min("v").alias("v")).select("id", "v.label", "v.embedding")


def _packed(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Vectors as the bytes of their numbers, with the norms of the whole ones, negative so that the largest come first."""
    for batch in batches:
        lists = batch.column("embedding")
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
        dims = np.array([len(v) for v in lists], np.int64)
        ends = np.cumsum(dims)
        x, down = whole(flat), np.zeros(len(batch))
        for d in np.unique(dims).tolist():
            own = np.flatnonzero(dims == d)
            down[own] = -norms(x[(ends[own] - d)[:, None] + np.arange(d)[None, :]])
        data = [flat[e - d : e].tobytes() for d, e in zip(dims, ends, strict=True)]
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "label": batch.column("label"), "dim": pa.array(dims), "vector": pa.array(data, pa.binary()), "down": pa.array(down)})


def level(norm: Column) -> Column:
    """The level of a norm, which grows with it; zero has the lowest."""
    return F.when(norm > 0, F.ceil(F.log2(norm) * FINENESS)).otherwise(-10_000 * FINENESS)


class Buckets:
    """Candidates in buckets by norm, of all rows or of those of each label, and how far a bound reaches into them."""

    def __init__(self, rows: DataFrame, by_label: bool, size: int, kind: str):
        n = rows.count()
        own = rows.withColumn("part", F.col("label") if by_label else F.lit(0).cast("long"))
        self.rows = write_table(in_order(own, "dim", "part", "down", "id", parts=max(1, -(-n // size))).withColumn("bucket", chunk()).drop("seq"), "buckets")
        self.by_label, self.kind = by_label, kind
        # of each part's buckets only the first, and the last of each level of norms: rows bounded by the levels
        most = self.rows.groupBy("dim", "part", "bucket").agg(F.max(-F.col("down")).alias("most"))
        levels = most.groupBy("dim", "part", level(F.col("most")).alias("level")).agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"))
        self.levels = levels.groupBy("dim", "part").agg(F.min("first").alias("first"), F.collect_list(F.struct("level", "last")).alias("levels"))

    def search(self, asked: DataFrame, k: int) -> DataFrame:
        """anchor, win, score and id: the first k candidates in each window of asked (id, label, dim, vector, down, wins, lows,
        highs), of the anchor's label where buckets are those of a label, else of others."""
        asked = asked.withColumn("part", F.col("label") if self.by_label else F.lit(0).cast("long")).join(self.levels, ["dim", "part"])
        found = write_table(self._visit(asked.withColumn("bucket", F.col("first")), k), "found")
        # the kth score of the first bucket is the next bound
        rank = F.row_number().over(Window.partitionBy("anchor", "win").orderBy(F.desc("score"), "id"))
        kth = found.withColumn("rank", rank).filter(F.col("rank") == k).groupBy(F.col("anchor").alias("k_anchor")).agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("win", F.lit(-1).cast("long")), "score"))).alias("kths"))
        more = asked.join(kth, F.col("id") == F.col("k_anchor"), "left")
        raised = F.zip_with("wins", "lows", lambda w, low: F.greatest(low, F.coalesce(F.element_at("kths", F.coalesce(w, F.lit(-1).cast("long"))), low)))
        more = more.withColumn("lows", raised)
        norm, bound = -F.col("down"), F.array_min("lows").cast("double")
        need = F.when(bound <= 0, level(F.lit(0.0))).when(norm > 0, level(bound / norm * (1 - 1e-9)) - 1).otherwise(1 << 30)
        last = F.array_max(F.transform(F.filter("levels", lambda x: x["level"] >= need), lambda x: x["last"]))
        more = more.withColumn("last", last).filter(F.col("last") > F.col("first"))
        more = more.withColumn("bucket", F.explode(F.sequence(F.col("first") + 1, "last")))
        both = found.unionByName(self._visit(more, k))
        return both.withColumn("rank", rank).filter(F.col("rank") <= k)

    def _visit(self, visits: DataFrame, k: int) -> DataFrame:
        kind, same = self.kind, self.by_label
        nothing = F.lit(None).cast("array<long>")
        columns = ["dim", "part", "bucket", "is_anchor", "id", "label", "vector", "wins", "lows", "highs"]
        own = self.rows.withColumns({"is_anchor": F.lit(False), "wins": nothing, "lows": nothing, "highs": nothing})
        both = own.select(*columns).unionByName(visits.withColumn("is_anchor", F.lit(True)).select(*columns))
        dealt = both.repartition("dim", "part", "bucket").sortWithinPartitions("dim", "part", "bucket", "is_anchor")
        return dealt.mapInArrow(lambda it: _search(it, k, same, kind), "anchor long, win long, score long, id long")


def mine(vectors: DataFrame, anchors: str = "id % 50 = 0", positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), bucket: int = BUCKET) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``window`` is in hundredths of the positive's score, both ends included; ``anchors`` is a condition on id.
    """
    ship(vectors.sparkSession)
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    lists = usable(vectors).select("id", "label", F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"))
    rows = write_table(lists.mapInArrow(lambda it: _packed(it, kind), "id long, label long, dim long, vector binary, down double"), "vectors")
    asked = rows.filter(anchors)
    one = lambda v: F.array(F.lit(v).cast("long"))
    first = asked.withColumns({"wins": one(None), "lows": one(-LONGEST), "highs": one(LONGEST)})
    near = Buckets(rows, True, bucket, kind).search(first, positives)
    near = write_table(near.select(F.col("anchor").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives", 0)
    hundredth = F.col("positive_score").cast("decimal(20,0)") / 100
    ends = near.select("*", F.ceil(hundredth * window[0]).cast("long").alias("low"), F.floor(hundredth * window[1]).cast("long").alias("high")).filter("low <= high")
    windows = ends.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("positive_id").alias("w"), "low", "high")).alias("ws"))
    second = asked.join(windows, F.col("id") == F.col("anchor_id")).select("id", "label", "dim", "vector", "down", F.col("ws.w").alias("wins"), F.col("ws.low").alias("lows"), F.col("ws.high").alias("highs"))
    found = Buckets(rows, False, bucket, kind).search(second, negatives)
    found = found.select(F.col("anchor").alias("f_anchor"), F.col("win").alias("f_positive"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    joined = near.join(found, (F.col("anchor_id") == F.col("f_anchor")) & (F.col("positive_id") == F.col("f_positive")))
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(vectors: DataFrame) -> DataFrame:
    """The contract's change: every seventh id has the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", "embedding", label.alias("label"))


MINE_SQL = """
WITH v AS (
  SELECT vec_id, min(CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT)) AS label,
         list_transform(any_value(embedding), lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 100 * n.score BETWEEN 50 * positive_score AND 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 3
"""
