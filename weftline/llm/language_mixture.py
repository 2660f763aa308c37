"""Language identification as a mixture: the share of each language in a document, by expectation-maximisation.

Training counts letter trigrams (with word boundaries, hashed to a fixed number of bins) of all labelled documents, by
language. A document's trigrams are taken as drawn from a mixture of the languages; expectation-maximisation estimates
the shares. The set of languages is chosen by penalised likelihood among the best one, the best two, and so on in the
order of their shares; the prediction is the largest share within the set, the score that share.

Defined results: `und` with score 0 for null texts, texts without letters and if nothing was learned from; ties go to the
language first in order; a text of any length counts whole; repeated rows give repeated results; an empty table gives an empty result; extra columns are
ignored. The model has (languages x bins) numbers, and the bins shrink as languages grow: 4 million numbers at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Numbers in the model at most; bins for one language at most; rounds of expectation-maximisation.
MODEL, BINS, ROUNDS = 1 << 22, 1 << 15, 12
#: A share, of the mixture of all languages, below which a language can't pay for itself.
NEGLIGIBLE = 0.01
STEP = 1 << 18
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For every code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _letters


def trigram_bins(texts: list[str | None], bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bin) of every trigram of the texts; other characters than letters count as one space."""
    lowered = [(t or "").lower() for t in texts]
    sizes = np.array([len(t) for t in lowered])
    codes = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.concatenate([[0], np.repeat(np.arange(len(texts)), sizes + 1)]).astype(np.int32)
    letter = letter_table()[codes]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # one space after each word
    codes, owner, letter = np.where(letter, codes, 32)[keep].astype(np.uint64), owner[keep], letter[keep]
    if len(codes) < 3:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    mixed = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    at = np.flatnonzero(letter[1:-1])  # the middle is a letter: each trigram belongs to one word
    return owner[1:-1][at], ((mixed[at] >> np.uint64(40)) % np.uint64(bins)).astype(np.int64)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about STEP characters; a longer document comes alone."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.utf8_length(batch.column("text").fill_null("")).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + STEP)))
        yield batch.slice(at, to - at)
        at = to


def _count_batches(batches: Iterator[pa.RecordBatch], bins: int) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in _parts(batch):
            doc, at = trigram_bins(part.column("text").to_pylist(), bins)
            langs = part.column("lang").to_pylist()
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs])[doc] if len(doc) else doc
            found = np.bincount(code * bins + at, minlength=len(names) * bins).reshape(len(names), bins)
            for name, row in zip(names, found, strict=True):
                counts[name] = counts[name] + row if name in counts else row
    for name, row in counts.items():
        some = np.flatnonzero(row)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(some), pa.string()), "bin": pa.array(some, pa.int64()), "n": pa.array(row[some], pa.int64())})


class Mixture:
    def __init__(self, langs: list[str], counts: np.ndarray, smooth: float = 0.5):
        self.langs = langs
        bins = counts.shape[1] if len(langs) else BINS
        self.bins = bins
        self.likelihood = ((counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * bins)).astype(np.float64) if len(langs) else np.zeros((0, bins))

    def shares(self, doc: np.ndarray, at: np.ndarray, n: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
        """For n documents the chosen languages' shares (0 for others), and how many trigrams each has."""
        k = len(self.langs)
        key, count = np.unique(doc.astype(np.int64) * self.bins + at, return_counts=True)
        doc, p = key // self.bins, self.likelihood[:, key % self.bins]  # a row for each language
        starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, int)
        out, size = np.zeros((n, k)), np.zeros(n)
        if not len(starts) or not k:
            return out, size
        ids = doc[starts]
        total = np.add.reduceat(count, starts).astype(float)
        row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(doc))))
        scale = p.max(axis=0)
        p, weight = p / scale, count.astype(float)
        base = np.add.reduceat(weight * np.log(scale), starts)

        def fit(mask: np.ndarray, steps: int, only: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Shares and log-likelihood of the documents ``only``, with the languages that their mask allows."""
            some = only[row] if not only.all() else slice(None)
            own, w = p[:, some], weight[some]
            at = (np.cumsum(only) - 1)[row[some]]
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            n_all, pi = total[only], mask / mask.sum(axis=0)
            for _ in range(steps):
                joint = pi[:, at]
                joint *= own
                joint *= w / joint.sum(axis=0)
                pi = np.add.reduceat(joint, first, axis=1) / n_all
            return pi, base[only] + np.add.reduceat(w * np.log((own * pi[:, at]).sum(axis=0)), first)

        every = np.ones(len(ids), bool)
        full, _ = fit(np.ones((k, len(ids))), rounds, every)
        rank = np.argsort(np.argsort(-full, axis=0, kind="stable"), axis=0)
        ordered = -np.sort(-full, axis=0)
        best, best_value = np.zeros_like(full), np.full(len(ids), -np.inf)
        for m in range(1, k + 1):
            open_ = every if m == 1 else ordered[m - 1] > NEGLIGIBLE
            if not open_.any():
                break
            pi, value = fit((rank[:, open_] < m).astype(float), 0 if m == 1 else rounds, open_)
            value -= m * np.log(np.maximum(total[open_], 2))  # a language more must explain more than its share costs
            where = np.flatnonzero(open_)
            better = value > best_value[where]
            best[:, where[better]], best_value[where[better]] = pi[:, better], value[better]
        out[ids], size[ids] = best.T, total
        return out, size


def train(docs: DataFrame, learn: Column) -> Mixture:
    """The model of all documents that ``learn`` holds for and that have a language."""
    ship(docs.sparkSession)
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    langs = sorted(r[0] for r in docs.filter(learn & F.col("lang").isNotNull()).select("lang").distinct().collect())  # names of languages
    bins = int(min(BINS, MODEL // max(1, len(langs))))
    if bins < 64:
        raise ValueError(f"{len(langs)} languages are more than the model's size allows")
    found = rows.mapInArrow(lambda it: _count_batches(it, bins), "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(langs), bins))
    counts[np.searchsorted(np.array(langs, object), found["lang"].to_numpy(object)), found["bin"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    return Mixture(langs, counts)


def _predict_batches(batches: Iterator[pa.RecordBatch], model, keep: list[str], text_out: bool) -> Iterator[pa.RecordBatch]:
    mixture: Mixture = model.value
    for batch in batches:
        for part in _parts(batch):
            doc, at = trigram_bins(part.column("text").to_pylist(), mixture.bins)
            shares, size = mixture.shares(doc, at, len(part))
            known = (size > 0) & (shares.max(axis=1, initial=0) > 0)
            best = shares.argmax(axis=1) if len(mixture.langs) else np.zeros(len(part), int)
            columns = {c: part.column(c) for c in keep}
            columns["lang_pred"] = pa.array([mixture.langs[b] if k else "und" for b, k in zip(best, known, strict=True)], pa.string())
            columns["score"] = pa.array(np.where(known, np.clip(shares.max(axis=1, initial=0), 0, 1), 0.0))
            columns["n_languages"] = pa.array((shares > 0).sum(axis=1).astype(np.int32))
            yield pa.RecordBatch.from_pydict(columns)


def held_out(parts: int) -> Column:
    """Whether crc32 of doc_id, as text, leaves the remainder 2; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % parts == 2


def identify(docs: DataFrame, model: Mixture | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the number of languages found, for every document."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model or train(docs, ~held_out(4)))
    ddl = f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, n_languages int"
    rows = docs.select("doc_id", held_out(4).alias("held_out"), "text")
    return rows.mapInArrow(lambda it: _predict_batches(it, shared, ["doc_id", "held_out"], False), ddl)


def keep_identified(docs: DataFrame, least: float = 0.34) -> DataFrame:
    """``docs`` without those that have no letters or no language with about a third of the text."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(train(docs, ~held_out(4)))
    columns = docs.columns

    def kept(batches):
        for batch in batches:
            at = 0
            for part in _predict_batches(iter([batch.select(["text"])]), shared, ["text"], True):
                own = batch.slice(at, len(part))
                at += len(part)
                score = part.column("score").to_numpy()
                known = np.array([x != "und" for x in part.column("lang_pred").to_pylist()])
                yield own.select(columns).filter(pa.array(known & (score >= least)))

    return docs.mapInArrow(kept, docs.schema)
