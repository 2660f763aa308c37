"""An interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted arrays, memory-mapped to score.

Counting: tasks hash the words of their texts (64 bits) and count them; each shard of the hash range becomes one sorted
array of hashes with counts, and a word's number is its place in all of them. With these numbers tasks count word
pairs; a pair is one number, its shard a hash of it, so that the pairs of a very frequent word are dealt over all shards.
Each shard of pairs becomes a sorted array too, and sends on, by word, how many pairs with counts 1, 2 and more it has
and how many words stand before it. All of it grows with the corpus; the driver sees a row for each shard.

Scoring: workers map the arrays from the shared folder and look up the distinct words and pairs of half a megabyte of
text at a time. p(w | v) = max(c(vw) - D, 0) / c(v) + g(v) * q(w), where q is the same over the numbers of preceding
words, interpolated with 1 / (V + 1) for each known word and one for all unknown ones.

Defined results: null and empty texts are one end token; without training texts every score is that of a uniform model
over nothing, 0; a text of any length is scored whole, a megabyte at a time; an unknown word has the unknown word's probability, and after it the model falls back to q; repeated rows
give repeated results; extra columns are ignored. Up to 2**32 distinct words, which is checked.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, ship
from .textops import U64, keys, mix64, text_bytes, word_hashes

#: Pairs of one shard, about; keys that a counting task holds before it sends them on.
SHARD, HOLD = 4_000_000, 3_000_000
#: Bytes of text for whose words there is one shard at least, so that a shard stays small however large the corpus is.
SHARD_TEXT = 64 << 20
END = keys(1, 99)[0]


def token_stream(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(token hashes, the number of tokens of each text) for a few texts at a time; each text ends with END."""
    data, off = text_bytes(column)
    at = 0
    while at < len(off) - 1:
        to = max(at + 1, int(np.searchsorted(off, off[at] + (1 << 20), "right")) - 1)
        part = off[at : to + 1] - off[at]
        words, start, _ = word_hashes(data[off[at] : off[to]], part, lower=True)
        ends = np.searchsorted(start, part[1:])
        yield np.insert(words, ends, END), np.diff(np.concatenate([[0], ends])) + 1
        at = to


def pack(values: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte by byte of all, which compresses well."""
    step = np.diff(values.astype(U64), prepend=U64(0))
    return step.view(np.uint8).reshape(len(step), 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    step = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(U64).ravel()
    return np.add.accumulate(step)


def plain(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype(np.uint32)).view(np.uint8).reshape(-1, 4).T.tobytes()


def unplain(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and the sums of their values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    return key[first], *(np.add.reduceat(v[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64) for v in values)


def _write(path: str, array: np.ndarray) -> None:
    """Whole or not at all, whichever attempt of a task comes last."""
    temp = f"{path}.{uuid.uuid4().hex}"
    array.tofile(temp)
    os.replace(temp, path)


class _Counter:
    """Keys with counts, merged now and then; what has become too much is sent on."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, key: np.ndarray) -> None:
        part = np.unique(key, return_counts=True)
        self.parts.append(part)
        self.size += len(part[0])
        if self.size > HOLD and len(self.parts) > 1:
            self.parts = [summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
            self.size = len(self.parts[0][0])

    @property
    def full(self) -> bool:
        return self.size > HOLD

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True))) if self.parts else (np.zeros(0, U64), np.zeros(0, np.int64))
        self.parts, self.size = [], 0
        return out


_BLOBS = "shard int, ids binary, n binary"


def _blobs(shard: np.ndarray, key: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of packed keys, one for each shard; keys are sorted."""
    order = np.argsort(shard, kind="stable")
    shard, key, count = shard[order], key[order], count[order]
    cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else []
    for a, b in zip(cuts, [*cuts[1:], len(shard)], strict=False):
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard[a]], pa.int32()), "ids": pa.array([pack(key[a:b])], pa.binary()), "n": pa.array([plain(count[a:b])], pa.binary())})


def _gather(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple[bytes, bytes]]]:
    got: dict[int, list[tuple[bytes, bytes]]] = {}
    for batch in batches:
        for shard, ids, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "ids", "n")), strict=True):
            got.setdefault(shard, []).append((ids, n))
    return got


def word_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def pair_shard(pairs: np.ndarray, shards: int) -> np.ndarray:
    return word_shard(mix64(pairs), shards)


def _count_words(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    counter = _Counter()
    for batch in batches:
        for tokens, _ in token_stream(batch.column("text")):
            counter.add(tokens)
            if counter.full:
                key, count = counter.take()
                yield from _blobs(word_shard(key, shards), key, count)
    key, count = counter.take()
    yield from _blobs(word_shard(key, shards), key, count)


def _write_words(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for shard, rows in _gather(batches).items():
        key, count = summed(np.concatenate([unpack(a) for a, _ in rows]), np.concatenate([unplain(b) for _, b in rows]))
        _write(f"{folder}/word-{shard}", key)
        _write(f"{folder}/count-{shard}", count)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "v": pa.array([len(key)], pa.int64()), "n": pa.array([int(count.sum())], pa.int64())})


class Arrays:
    """The model's files, mapped when first used."""

    def __init__(self, folder: str, sizes: list[int], pair_shards: int = 0):
        self.folder, self.sizes, self.pair_shards = folder, sizes, pair_shards
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.v = int(self.offsets[-1])
        self.files: dict[str, int] | None = None  # sizes in bytes, once all is written
        self._open: dict[str, np.ndarray] = {}

    def seal(self, pairs: int) -> None:
        """Note the files that there are; from now on one that is missing or short is an error, not an empty one."""
        self.files = {e.name: e.stat().st_size for e in os.scandir(self.folder)}
        held = sum(self.files.get(f"pair-{s}", 0) for s in range(self.pair_shards)) // 8
        words = sum(self.files.get(f"word-{s}", 0) for s in range(len(self.sizes))) // 8
        if (held, words) != (pairs, self.v):
            raise OSError(f"{self.folder} holds {words} words and {held} pairs of {self.v} and {pairs}")

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def get(self, name: str, dtype) -> np.ndarray:
        if name not in self._open:
            path = f"{self.folder}/{name}"
            size = self.files.get(name, 0) if self.files is not None else os.path.getsize(path)
            if size and os.path.getsize(path) != size:
                raise OSError(f"{path} has {os.path.getsize(path)} bytes of {size}")
            self._open[name] = np.memmap(path, dtype, "r") if size else np.zeros(0, dtype)
        return self._open[name]

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of sorted hashes, -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        shards = len(self.sizes)
        cuts = np.searchsorted(word_shard(hashes, shards), np.arange(shards + 1))
        for s in range(shards):
            a, b = cuts[s], cuts[s + 1]
            if a < b and self.sizes[s]:
                table = self.get(f"word-{s}", U64)
                at = np.minimum(np.searchsorted(table, hashes[a:b]), len(table) - 1)
                out[a:b] = np.where(table[at] == hashes[a:b], at + self.offsets[s], -1)
        return out

    def by_word(self, prefix: str, dtype, ids: np.ndarray, width: int = 1) -> np.ndarray:
        """Values of sorted word numbers; 0 for -1."""
        out = np.zeros((len(ids), width), np.int64)
        cuts = np.searchsorted(ids, self.offsets)
        for s in range(len(self.sizes)):
            a, b = cuts[s], cuts[s + 1]
            if a < b:
                out[a:b] = self.get(f"{prefix}-{s}", dtype).reshape(-1, width)[ids[a:b] - self.offsets[s]]
        return out if width > 1 else out[:, 0]

    def pairs(self, keys_: np.ndarray) -> np.ndarray:
        """Counts of sorted pairs, 0 for unknown ones."""
        out = np.zeros(len(keys_), np.int64)
        shard = pair_shard(keys_, self.pair_shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.pair_shards + 1))
        for s in range(self.pair_shards):
            own = order[cuts[s] : cuts[s + 1]]
            table = self.get(f"pair-{s}", U64)
            if len(own) and len(table):
                at = np.minimum(np.searchsorted(table, keys_[own]), len(table) - 1)
                out[own] = np.where(table[at] == keys_[own], self.get(f"paircount-{s}", np.uint32)[at], 0)
        return out

    def lookup(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct word numbers with -1 first if there is an unknown word, place of each token's in them)."""
        distinct, at = np.unique(tokens, return_inverse=True)
        ids = self.words(distinct)
        order = np.argsort(ids, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return ids[order], back[at], ids[at]


def histories(ids: np.ndarray, counts: np.ndarray, begin: int) -> np.ndarray:
    """The word number before each token; ``begin`` at the start of a text."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    starts = np.cumsum(counts) - counts
    before[starts] = begin
    return before


def _count_pairs(batches: Iterator[pa.RecordBatch], arrays: Arrays) -> Iterator[pa.RecordBatch]:
    counter, width = _Counter(), U64(arrays.v + 1)

    def send():
        key, count = counter.take()
        yield from _blobs(pair_shard(key, arrays.pair_shards), key, count)

    for batch in batches:
        for tokens, counts in token_stream(batch.column("text")):
            _, _, ids = arrays.lookup(tokens)
            counter.add(histories(ids, counts, arrays.v).astype(U64) * width + ids.astype(U64))
            if counter.full:
                yield from send()
    yield from send()


def _write_pairs(batches: Iterator[pa.RecordBatch], arrays: Arrays) -> Iterator[pa.RecordBatch]:
    """Write the shards; send on for each word shard what pairs tell about its words, and how many have counts 1 to 4."""
    width = U64(arrays.v + 1)
    for shard, rows in _gather(batches).items():
        key, count = summed(np.concatenate([unpack(a) for a, _ in rows]), np.concatenate([unplain(b) for _, b in rows]))
        _write(f"{arrays.folder}/pair-{shard}", key)
        _write(f"{arrays.folder}/paircount-{shard}", count.astype(np.uint32))
        left, right = (key // width).astype(np.int64), (key % width).astype(np.int64)
        seen, ones, twos, more = summed(left, count == 1, count == 2, count >= 3)
        after, before = summed(right, np.ones(len(right), np.int64))
        for s in range(len(arrays.sizes) + 1):  # the last one holds the begin of a text alone
            low, high = arrays.offsets[s], arrays.offsets[s + 1] if s < len(arrays.sizes) else arrays.v + 1
            a, b = np.searchsorted(seen, [low, high])
            c, d = np.searchsorted(after, [low, high])
            if a < b or c < d:
                parts = [plain(x[a:b]) for x in (ones, twos, more)]
                ids = [pack(seen[a:b] - low), pack(after[c:d] - low)]
                yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "ids": pa.array([len(ids[0]).to_bytes(8, "little") + b"".join(ids)], pa.binary()), "n": pa.array([b"".join([*parts, plain(before[c:d])])], pa.binary())})
        kinds = np.bincount(np.minimum(count, 5), minlength=6)[1:5]
        yield pa.RecordBatch.from_pydict({"shard": pa.array([-1], pa.int32()), "ids": pa.array([b""], pa.binary()), "n": pa.array([np.asarray(kinds, "<i8").tobytes()], pa.binary())})


def _write_stats(batches: Iterator[pa.RecordBatch], arrays: Arrays) -> Iterator[pa.RecordBatch]:
    """For each word of a shard: pairs that it begins with counts 1, 2 and more, and words that stand before it."""
    got = _gather(batches)
    for shard, rows in got.items():
        pairs, befores = np.zeros(4, np.int64), np.zeros(5, np.int64)
        if shard < 0:
            pairs += sum(np.frombuffer(n, "<i8") for _, n in rows)
        else:
            size = arrays.sizes[shard] if shard < len(arrays.sizes) else 1
            stats = np.zeros((size, 4), np.uint32)
            for ids, n in rows:
                cut = int.from_bytes(ids[:8], "little")
                seen, after = unpack(ids[8 : 8 + cut]).astype(np.int64), unpack(ids[8 + cut :]).astype(np.int64)
                for k in range(3):
                    stats[seen, k] += unplain(n[4 * k * len(seen) : 4 * (k + 1) * len(seen)])
                stats[after, 3] += unplain(n[12 * len(seen) :])
            _write(f"{arrays.folder}/stat-{shard}", stats)
            if shard < len(arrays.sizes):
                befores[:4] = np.bincount(np.minimum(stats[:, 3], 5), minlength=6)[1:5]
                befores[4] = stats[:, 3].sum()
        yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in (*pairs, *befores)], names=[f"x{i}" for i in range(9)])


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 1, 2 and more, from the numbers of counts 1 to 4."""
    if (n[:4] <= 0).any():
        return np.array([0.5, 1.0, 1.5])
    y = n[0] / (n[0] + 2 * n[1])
    return np.clip([1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]], 0.0, [1.0, 2.0, 3.0])


class Model:
    def __init__(self, arrays: Arrays, n: int, docs: int, pairs: np.ndarray, befores: np.ndarray):
        self.arrays, self.n, self.docs = arrays, n, docs
        self.pair_d, self.word_d = discounts(pairs), discounts(befores)
        self.all_pairs = int(befores[4])
        known = arrays.v
        some = befores[:2].astype(float).tolist()
        kinds = np.array([*some, known - sum(some)])  # every known word has a word or a begin before it
        self.word_rest = float((self.word_d * kinds).sum() / self.all_pairs) if self.all_pairs else 1.0

    def score(self, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known tokens, base score, log10 probability) of each text."""
        a = self.arrays
        distinct, place, ids = a.lookup(tokens)
        c, stats = a.by_word("count", np.int64, distinct), a.by_word("stat", np.uint32, distinct, 4)
        text = np.repeat(np.arange(len(counts)), counts)
        known = np.bincount(text, ids >= 0, len(counts)).astype(np.int64)
        base = np.bincount(text, np.log10((c + 1) / (self.n + a.v + 1))[place], len(counts))
        if not self.n:
            return known, base, np.zeros(len(counts))
        before = stats[:, 3]
        q = np.maximum(before - np.append(0.0, self.word_d)[np.minimum(before, 3)], 0) / self.all_pairs + self.word_rest / (a.v + 1)
        rest = (stats[:, :3] * self.pair_d).sum(axis=1) / np.maximum(c, 1)
        history = histories(ids, counts, a.v)
        begins = np.cumsum(counts) - counts
        at = np.concatenate([[0], place[:-1]])
        h_count, h_rest = c[at], np.where(c[at] > 0, rest[at], 1.0)
        h_count[begins] = self.docs
        h_rest[begins] = (a.get(f"stat-{len(a.sizes)}", np.uint32)[:3] * self.pair_d).sum() / self.docs
        both = (history >= 0) & (ids >= 0)
        key = history[both].astype(U64) * U64(a.v + 1) + ids[both].astype(U64)
        pairs, where = np.unique(key, return_inverse=True)
        n = np.zeros(len(ids), np.int64)
        n[both] = a.pairs(pairs)[where]
        p = np.maximum(n - np.append(0.0, self.pair_d)[np.minimum(n, 3)], 0) / np.maximum(h_count, 1) + h_rest * q[place]
        return known, base, np.bincount(text, np.log10(p), len(counts))


def train(docs: DataFrame) -> Model:
    """Count and store the model of all texts of ``docs``.

    Word shards number as many as shuffle partitions, or more where the texts' size, which is summed first, asks for it.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = shared_folder(spark, "kneser-ney")
    text = docs.select("text")
    n_docs, size = text.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_TEXT))
    words = text.mapInArrow(lambda it: _count_words(it, shards), _BLOBS).repartition(shards, "shard")
    rows = words.mapInArrow(lambda it: _write_words(it, folder), "shard int, v long, n long").collect()  # a row a shard
    sizes = [0] * shards
    for r in rows:
        sizes[r["shard"]] = r["v"]
    n = sum(r["n"] for r in rows)
    arrays = Arrays(folder, sizes, max(1, -(-n // SHARD)))
    if arrays.v >= 1 << 32:
        raise ValueError("more than 2**32 distinct words")
    pairs = text.mapInArrow(lambda it: _count_pairs(it, arrays), _BLOBS).repartition(arrays.pair_shards, "shard")
    stats = pairs.mapInArrow(lambda it: _write_pairs(it, arrays), _BLOBS).repartition(shards, "shard")
    names = [f"x{i}" for i in range(9)]
    total = stats.mapInArrow(lambda it: _write_stats(it, arrays), ", ".join(f"{x} long" for x in names)).agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in names]).first()
    ends = np.array(total, np.int64)
    arrays.seal(int(ends[8]))
    return Model(arrays, n, n_docs, ends[:4], ends[4:])


def _score_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [(counts, *model.score(tokens, counts)) for tokens, counts in token_stream(batch.column("text"))]
        counts, known, base, score = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0)] * 4
        columns = {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "n_tokens": pa.array(counts.astype(np.int64)), "n_known": pa.array(known.astype(np.int64))}
        yield pa.RecordBatch.from_pydict(columns | {"train_tokens": pa.array(np.full(len(batch), model.n)), "base_score": pa.array(base.astype(float)), "score": pa.array(score.astype(float))})


def score_texts(docs: DataFrame, held: Column) -> DataFrame:
    """Scores of all documents under the model of those for which ``held`` is false.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one words) and score (log10 probability).
    """
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    model = train(rows.filter(~F.col("held_out")))
    ddl = f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.mapInArrow(lambda it: _score_batches(it, model), ddl)
