"""Byte-level BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The leaves of the tree hold (rank, position) of every adjacent pair, its root the lowest rank, leftmost first. A merge
takes the root's pair and updates three leaves and their ancestors, until no pair can be merged: O(log n) a merge, also
for a piece of a megabyte. Pieces of similar length are merged together as columns of one array.

A vocabulary file of the tokenizers library (byte-level BPE, no normaliser, no prefix space) is read on the driver; its
path is a parameter. Defined results: null and empty texts have no tokens; the file's special tokens in a text become
their ids; decoding replaces bytes that are no UTF-8; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import ship

#: Text that is encoded together, in characters; pieces that a worker remembers at most, and their longest.
STEP, CACHE, SHORT = 1 << 18, 100_000, 32
#: Bits of the hash table from pair to rank.
SLOTS = 20
#: Leaves of the trees that are worked on together; they should fit in a processor's cache.
BLOCK = 1 << 17
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"  # Unicode white space
#: How byte-level vocabularies of this kind cut a text into pieces (fixed by their format).
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Where a piece always ends: before a single space between characters that aren't white space.
_CHUNK = re.compile(r"(?<=\S)(?= \S)")


def byte_characters() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, and its byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class BytePairs:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        of = byte_characters()
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = [b""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for token, i in vocab.items():
            self.tokens[i] = bytes(of[c] for c in token)
        for token, i in self.specials.items():
            self.tokens[i] = token.encode()
        self.byte_id = np.zeros(256, np.int64)
        for c, b in of.items():
            self.byte_id[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._hash(key)
        self.rank_of = {int(k): i for i, k in enumerate(key)}
        self._cache: dict[str, bytes] = {}

    def __getstate__(self):
        return self.__dict__ | {"_cache": {}}

    def _hash(self, key: np.ndarray) -> None:
        """A sparse hash table from pair to rank, and the pairs that collide in it as a short sorted list."""
        at, every = self._slot(key), np.arange(len(key), dtype=np.int32)
        self.keys = np.append(key, -1)
        self.slots = np.full(1 << SLOTS, len(key), np.int32)
        self.slots[at] = every
        rest = every[self.slots[at] != every]
        self.rest_ranks = rest[np.argsort(key[rest])]
        self.rest_keys = key[self.rest_ranks]

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 if it can't be merged."""
        key = left << 32 | right
        rank = self.slots[self._slot(key)]
        found = self.keys[rank]
        odd = np.flatnonzero((found != key) & (found >= 0))  # an empty slot has no pair that collided in it
        rank[found != key] = -1
        if len(odd) and len(self.rest_keys):
            at = np.minimum(np.searchsorted(self.rest_keys, key[odd]), len(self.rest_keys) - 1)
            rank[odd] = np.where(self.rest_keys[at] == key[odd], self.rest_ranks[at], -1)
        return rank

    def merge_one(self, piece: bytes) -> list[int]:
        """One piece, with a segment tree in plain lists."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        leaves = 1 << max(1, (n - 1).bit_length())
        none = (1 << 62, 0)
        rank_of = self.rank_of

        def leaf(i: int, j: int) -> tuple[int, int]:
            rank = rank_of.get(ids[i] << 32 | ids[j]) if 0 <= i and j < n else None
            return none if rank is None else (rank, i)

        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            tree[leaves + i] = leaf(i, i + 1)
        for i in range(leaves - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        gone = [False] * n
        while tree[1] is not none and tree[1][0] < 1 << 62:
            rank, i = tree[1]
            j = after[i]
            k = after[j]
            ids[i] = int(self.result[rank])
            gone[j] = True
            after[i] = k
            if k < n:
                before[k] = i
            p = before[i]
            for at, value in ((j, none), (i, leaf(i, k)), (p, leaf(p, i))):
                if at >= 0:
                    node = leaves + at
                    tree[node] = value
                    while node > 1:
                        node >>= 1
                        tree[node] = min(tree[2 * node], tree[2 * node + 1])
        return [x for x, g in zip(ids, gone, strict=True) if not g]

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Pieces of at most the same power of two of bytes, each a column of the arrays; their ids as bytes."""
        sizes = np.array([len(p) for p in pieces])
        bits = max(1, int(sizes.max() - 1).bit_length())
        leaves, n = 1 << bits, len(pieces)
        column = np.repeat(np.arange(n), sizes)
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        kind = np.int32 if len(self.result) < 1 << (30 - bits) else np.int64
        none = np.iinfo(kind).max
        # row r of column c is at r * n + c; ids has a row of -1 below, links point to it at the end of a piece
        ids = np.full((leaves + 1) * n, -1, np.int64)
        ids[place * n + column] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.repeat(np.arange(1, leaves + 2), n)
        before = np.repeat(np.arange(-1, leaves), n)
        live = ids >= 0
        tree = np.full(2 * leaves * n, none, kind)

        def leaf(i, j, c):
            a, b = ids[i * n + c], ids[j * n + c]
            rank = self.ranks(a, np.maximum(b, 0))
            return np.where((b >= 0) & (rank >= 0), rank.astype(kind) << bits | i, none)

        inner = place + 1 < sizes[column]
        i, c = place[inner], column[inner]
        tree[(leaves + i) * n + c] = leaf(i, i + 1, c)
        levels = tree.reshape(2 * leaves, n)
        for level in range(bits - 1, -1, -1):
            a = 1 << level
            levels[a : 2 * a] = np.minimum(levels[2 * a : 4 * a : 2], levels[2 * a + 1 : 4 * a : 2])
        c = np.flatnonzero(levels[1] < none)
        while len(c):
            top = levels[1, c]
            i = (top & (leaves - 1)).astype(np.int64)
            own, j = i * n + c, after[i * n + c]
            k = np.minimum(after[j * n + c], leaves)
            p = before[own]
            ids[own] = self.result[top >> bits]
            ids[j * n + c] = -1
            live[j * n + c] = False
            after[own] = k
            before[k * n + c] = i
            has = np.flatnonzero(p >= 0)
            at = np.concatenate([j, i, p[has]])
            cs = np.concatenate([c, c, c[has]])
            values = np.concatenate([np.full(len(c), none, kind), leaf(np.concatenate([i, p[has]]), np.concatenate([k, i[has]]), np.concatenate([c, c[has]]))])
            node = at + leaves
            tree[node * n + cs] = values
            for _ in range(bits):
                node >>= 1
                child = 2 * n * node + cs
                tree[node * n + cs] = np.minimum(tree[child], tree[child + n])
            c = c[levels[1, c] < none]
        ids, live = ids.reshape(leaves + 1, n), live.reshape(leaves + 1, n)
        flat = ids[:leaves].T[live[:leaves].T].astype("<u4").tobytes()
        ends = (4 * np.cumsum(live[:leaves].sum(axis=0))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of every piece as little-endian 32-bit numbers."""
        out: list[bytes] = [b""] * len(pieces)
        groups: dict[int, list[int]] = {}
        for at, p in enumerate(pieces):
            groups.setdefault((len(p) - 1).bit_length(), []).append(at)
        for bits, group in groups.items():
            step = max(1, BLOCK >> bits)
            for first in range(0, len(group), step):
                places = group[first : first + step]
                part = [pieces[i] for i in places]
                if bits == 0 or len(part) < 16:
                    ids = [np.array(self.merge_one(p), "<u4").tobytes() for p in part]
                else:
                    ids = self.merge_many(part)
                for i, x in zip(places, ids, strict=True):
                    out[i] = x
        return out

    def _parts(self, text: str) -> list[str]:
        """The text cut at the special tokens, which are parts of their own."""
        if not self.specials or not any(map(text.__contains__, self.specials)):
            return [text]
        return re.split("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")", text)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        chunked, cache = [], self._cache
        for text in texts:
            chunks: list[str] = []
            for part in self._parts(text or ""):
                if part in self.specials:
                    chunks.append(part)
                elif part:
                    chunks += _CHUNK.split(part)
            chunked.append(chunks)
        missing = {c for chunks in chunked for c in chunks if c not in cache and c not in self.specials}
        known = {t: int(i).to_bytes(4, "little") for t, i in self.specials.items()}
        new, pieces = set(), {}
        for c in missing:
            if (c[0] == " " or c[0].isalpha()) and c[1:].isalpha():  # one piece, as most chunks are
                new.add(c)
            else:
                pieces[c] = own = _ascii_pieces(c) if c.isascii() else _pieces(c)
                new.update(own)
        order = [p for p in new if p not in cache]
        known.update(zip(order, self.merge([p.encode() for p in order]), strict=True))
        for c, own in pieces.items():
            if len(own) > 1:
                known[c] = b"".join([known[p] if p in known else cache[p] for p in own])
        out = [b"".join([known[c] if c in known else cache[c] for c in chunks]) for chunks in chunked]
        kept = {c: x for c, x in known.items() if len(c) <= SHORT and c not in self.specials}
        if len(cache) + len(kept) > CACHE:
            cache.clear()
        if len(kept) <= CACHE:
            cache.update(kept)
        return out

    def encode_parts(self, text: str) -> Iterator[bytes]:
        """The ids of one text, a stretch of about STEP characters at a time; stretches end where a piece always ends."""
        for part in self._parts(text):
            if part in self.specials:
                yield int(self.specials[part]).to_bytes(4, "little")
                continue
            at = 0
            while at < len(part):
                cut = _CHUNK.search(part, at + STEP)
                to = cut.start() if cut else len(part)
                yield self.encode_batch([part[at:to]])[0]
                at = to

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_pieces = regex.compile(PIECES).findall
#: The same for ASCII alone, in the faster library.
_ascii_pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+").findall


def _digest(pairs: BytePairs, parts) -> tuple[int, str, str]:
    """Number of ids and the digests of ids and decoded text; bytes of a character may be in two parts."""
    ids_sha, text_sha, n = hashlib.sha256(), hashlib.sha256(), 0
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for ids in parts:
        ids_sha.update(ids)
        n += len(ids) // 4
        text_sha.update(decoder.decode(pairs.decode_bytes(ids)).encode())
    text_sha.update(decoder.decode(b"", True).encode())
    return n, ids_sha.hexdigest(), text_sha.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    pairs: BytePairs = model.value
    for batch in batches:
        texts = batch.column("text")
        for first, last in _steps(texts):
            part = texts.slice(first, last - first).to_pylist()
            if last - first == 1 and len(part[0] or "") > STEP:
                rows = [_digest(pairs, pairs.encode_parts(part[0]))]
            else:
                rows = [_digest(pairs, [ids]) for ids in pairs.encode_batch(part)]
            n, ids_sha, text_sha = zip(*rows, strict=True)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(first, last - first), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha), "decoded_sha256": pa.array(text_sha)})


def _steps(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about STEP bytes of text; a longer text is alone."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + STEP, "right")))
        yield at, to
        at = to


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them, for every document."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(BytePairs(path))  # the size of the vocabulary file
    ddl = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(lambda it: _digests(it, model), ddl)


def _token_lists(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for first, last in _steps(texts):
            ids = model.value.encode_batch(texts.slice(first, last - first).to_pylist())
            off = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(first, last - first), "ids": pa.ListArray.from_arrays(off, np.frombuffer(b"".join(ids), "<u4").astype(np.int32))})


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the token ids of every document."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(BytePairs(path))
    return docs.select("doc_id", "text").mapInArrow(lambda it: _token_lists(it, model), f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")
