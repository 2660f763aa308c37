"""Removal of long repeated byte strings by a sparse enhanced suffix array.

Sorting every suffix of a corpus is out of reach, and isn't needed: of the 50-byte grams in any 250 bytes the one with
the least hash (leftmost of equal ones) is an anchor, so equal strings of 250 bytes or more have an anchor at the same
place. The suffixes at anchors are brought together by their gram, with the 201 bytes before and the 401 bytes from
the anchor as context, which hold every 400-byte string whose first 250 bytes the anchor stands for.

An anchor whose gram occurs once is done with. Occurrences with equal contexts (by hash) repeat all their strings. For
grams with different contexts, one of each kind is fetched and the group becomes an enhanced suffix array: contexts
sorted by what follows the anchor, the longest common prefixes of neighbours, and a stack scan over these that yields
the interval tree. In each interval the members' left extensions are sorted in turn; where they differ the repeat is
left-maximal, and an occurrence whose left and right common parts reach 400 bytes with another one is repeated there.
All strings that an anchor stands for hold the anchor, so what they cover of a context is one range.

Beside the 400-byte rule, which decides what is removed, the repeats of 250 bytes or more that hold over 50 whole words
are counted in whole words (``n_passage_words``): 50 words of prose are some 300 bytes, which the rule leaves in place. A passage of
over 50 words that is shorter than 250 bytes isn't looked for.

A gram with more than GROUP kinds of contexts isn't compared in one task: each of its contexts sends on the hashes of
its strings of 400 bytes and of over 50 words (some 400 numbers, whatever the group's size), which are counted like any
others. So no task holds a hot gram's occurrences, and none is dropped.

Joins by gram are between written tables, so that Spark splits the partition of a hot one. What is to be fetched or
removed is written as sorted arrays of about a million numbers to the shared folder, which tasks map when they go over
the texts again; a file that is missing or short is an error. Texts are never shuffled. Hashes are 64 bits for grams and
for contexts of one gram, 96 for documents and for strings of hot grams.

Defined results: null and empty texts are 0 bytes, nothing removed; texts under 400 bytes are kept whole; a text of any
length is taken in pieces whose anchors are those of the whole; rows that repeat a document repeat all its strings; of
equal strings none is kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, ship, write_table
from .kneser_ney import _write
from .textops import _P, _P_INV, _WS, U64, keys, mix64, powers, text_bytes

LENGTH, GRAM = 400, 50
#: Least bytes and whole words of a passage.
PASSAGE, WORDS = 250, 51
#: A context: from the start of a string to the anchor of its first PASSAGE bytes, at most, and to the end of a string of
#: LENGTH bytes, each with the byte beyond, which tells whether a word ends there.
BEFORE, AFTER = PASSAGE - GRAM + 1, LENGTH + 1
GROUP = 100_000
#: Bytes that one vectorised step takes on; a longer document is taken in overlapping pieces.
STEP = 1 << 19
#: Numbers of one sorted array, about; arrays that a task holds open.
SHARD, OPEN = 1 << 20, 1000
_TABLES = [keys(256, 21), keys(256, 22)]
_PLACE = U64((1 << 24) - 1)


class _Hashes:
    """Hashes of any part of a byte buffer, by sums over its beginnings."""

    def __init__(self, data: np.ndarray, table: np.ndarray):
        self.sums = np.zeros(len(data) + 1, U64)
        value = table[data]
        value *= powers(_P, len(data))
        np.add.accumulate(value, out=self.sums[1:])
        self.inverse = powers(_P_INV, len(data) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U64))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, U64)
    padded[:n] = values
    padded = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _pieces(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """(bytes, document numbers, their starts in the bytes, the place in its document that each begins with, and the
    range of the bytes whose anchors are this piece's: each place belongs to one piece, which holds all its context and
    the byte before it)."""
    at = 0
    while at < len(off) - 1:
        size = off[at + 1] - off[at]
        if size > 2 * STEP:
            for a in range(0, int(size), STEP):
                low, high = max(0, a - BEFORE - 1), min(int(size), a + STEP + 2 * AFTER)
                yield data[off[at] + low : off[at] + high], np.array([at]), np.array([0, high - low]), np.array([low]), a - low, (high if high == size else a + STEP) - low
                if high == size:
                    break
            at += 1
            continue
        to = max(at + 1, int(np.searchsorted(off, off[at] + STEP, "right")) - 1)
        yield data[off[at] : off[to]], np.arange(at, to), off[at : to + 1] - off[at], np.zeros(to - at, np.int64), 0, int(off[to] - off[at])
        at = to


def _word_counts(part: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place how many words start before it, and how many end at or before it; words end with documents."""
    solid = ~_WS[part]
    cut = starts[starts < len(part)]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    first[cut] = solid[cut]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    before = cut[cut > 0] - 1
    last[before] = solid[before]
    return tuple(np.concatenate([[0], np.cumsum(x, dtype=np.int32)]) for x in (first, last))


def anchors(data: np.ndarray, off: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
    """The anchors of all documents, some at a time: document number, place, gram and context hashes, context sizes and
    whether the context holds enough whole words for a passage.

    ``at`` and ``bytes`` tell where the context stands.
    """
    for part, docs, starts, shift, first, last in _pieces(data, off):
        if len(part) < PASSAGE:
            continue
        gram = _Hashes(part, _TABLES[0])
        place = np.arange(len(part) - GRAM + 1)
        h = gram(place, place + GRAM)
        least = sliding_least((h & ~_PLACE) | place.astype(U64), PASSAGE - GRAM + 1)
        sizes = np.diff(starts)
        full = sizes >= PASSAGE
        step = np.zeros(len(least) + 1, np.int32)
        np.add.at(step, starts[:-1][full], 1)
        np.add.at(step, (starts[:-1] + sizes - PASSAGE + 1)[full], -1)
        chosen = np.zeros(len(part), bool)
        chosen[(least[np.cumsum(step[:-1]) > 0] & _PLACE).astype(np.int64)] = True
        pos = np.flatnonzero(chosen)
        pos = pos[(pos >= first) & (pos < last)]
        if not len(pos):
            continue
        own = np.searchsorted(starts, pos, "right") - 1
        left = np.minimum(pos - starts[own], BEFORE)
        right = np.minimum(starts[own + 1] - pos, AFTER)
        context = _Hashes(part, _TABLES[1])(pos - left, pos + right) + mix64(left.astype(U64))
        begun, ended = _word_counts(part, starts)
        wide = ended[pos + right] - begun[pos - left] >= WORDS
        yield {"doc": docs[own], "pos": pos - starts[own] + shift[own], "h": h[pos], "c": context, "left": left, "right": right, "wide": wide, "at": pos, "bytes": part}


def document_keys(column: pa.Array, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row's text and doc_id."""
    both = [hashlib.blake2b(b"\0" if i is None else str(i).encode() + b"\1", digest_size=12) for i in ids.to_pylist()]
    data, off = text_bytes(column)
    for h, a, b in zip(both, off, off[1:], strict=False):
        h.update(data[a:b])
    raw = b"".join(h.digest() for h in both)
    rows = np.frombuffer(raw, np.uint8).reshape(-1, 12)
    return np.ascontiguousarray(rows[:, :8]).view(np.int64).ravel(), np.ascontiguousarray(rows[:, 8:]).view(np.int32).ravel()


_ANCHORS = "h long, c long, dk long, ck int, pos int, left short, right short, wide boolean"


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, check = document_keys(batch.column("text"), batch.column("doc_id"))
        for a in anchors(*text_bytes(batch.column("text"))):
            columns = {"h": a["h"].view(np.int64), "c": a["c"].view(np.int64), "dk": key[a["doc"]], "ck": check[a["doc"]], "pos": a["pos"].astype(np.int32), "left": a["left"].astype(np.int16), "right": a["right"].astype(np.int16), "wide": a["wide"]}
            yield pa.RecordBatch.from_pydict({c: pa.array(x) for c, x in columns.items()})


def request_keys(h: np.ndarray, c: np.ndarray, dk: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return mix64(h.view(U64) ^ mix64(c.view(U64) ^ mix64(dk.view(U64) + pos.astype(U64))))


def _top(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key.view(U64) >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def _shard_of(shards: int, column: str):
    """The shard of a signed 64-bit key, by its upper half taken as unsigned."""
    return F.expr(f"cast(shiftright(shiftrightunsigned({column}, 32) * {shards}L, 32) as int)")


_FILES = "name string, shard long, n long"


def _write_shards(arrays: dict[str, np.ndarray], shard: np.ndarray, folder: str) -> Iterator[pa.RecordBatch]:
    """A row for each file that is written."""
    for s in np.unique(shard):
        a, b = np.searchsorted(shard, [s, s + 1])
        for name, array in arrays.items():
            _write(f"{folder}/{name}-{s}", array[a:b])
        yield pa.RecordBatch.from_pydict({"name": pa.array(list(arrays)), "shard": pa.array([s] * len(arrays), pa.int64()), "n": pa.array([b - a] * len(arrays), pa.int64())})


class Shards:
    """Sorted arrays in a shared folder, mapped when first used; ``sizes`` says which there are."""

    def __init__(self, folder: str, shards: int, sizes: dict[tuple[str, int], int]):
        self.folder, self.shards, self.sizes = folder, shards, sizes
        self._open: OrderedDict[tuple[str, int], np.ndarray] = OrderedDict()

    def __getstate__(self):
        return self.__dict__ | {"_open": OrderedDict()}

    def get(self, name: str, shard: int, dtype) -> np.ndarray:
        size = self.sizes.get((name, shard), 0)
        if not size:
            return np.zeros(0, dtype)
        if (name, shard) not in self._open:
            array = np.memmap(f"{self.folder}/{name}-{shard}", dtype, "r")
            if len(array) != size:
                raise OSError(f"{self.folder}/{name}-{shard} has {len(array)} entries of {size}")
            self._open[name, shard] = array
            if len(self._open) > OPEN:
                self._open.popitem(last=False)
        self._open.move_to_end((name, shard))
        return self._open[name, shard]


def _stored(rows: DataFrame, write, spark: SparkSession, name: str, column: str, count: int) -> Shards:
    """Write about ``count`` rows as shards of a bounded size; the driver sees a row for each file."""
    shards = max(spark.sparkContext.defaultParallelism, -(-count // SHARD))
    folder = shared_folder(spark, name)
    files = rows.repartition(shards, _shard_of(shards, column)).mapInArrow(lambda it: write(it, folder, shards), _FILES).collect()
    return Shards(folder, shards, {(f["name"], f["shard"]): f["n"] for f in files})


def _context_batches(batches: Iterator[pa.RecordBatch], requests: Shards) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, _ = document_keys(batch.column("text"), batch.column("doc_id"))
        for a in anchors(*text_bytes(batch.column("text"))):
            wanted = request_keys(a["h"], a["c"], key[a["doc"]], a["pos"])
            shard, hit = _top(wanted, requests.shards), np.zeros(len(wanted), bool)
            for s in np.unique(shard):
                table, own = requests.get("request", int(s), U64), np.flatnonzero(shard == s)
                if len(table):
                    hit[own] = table[np.minimum(np.searchsorted(table, wanted[own]), len(table) - 1)] == wanted[own]
            at = np.flatnonzero(hit)
            context = [a["bytes"][p - x : p + y].tobytes() for p, x, y in zip(a["at"][at].tolist(), a["left"][at].tolist(), a["right"][at].tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"h": pa.array(a["h"][at].view(np.int64)), "c": pa.array(a["c"][at].view(np.int64)), "left": pa.array(a["left"][at].astype(np.int32)), "context": pa.array(context, pa.binary())})


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    m = min(len(a), len(b))
    x = int.from_bytes(a[:m], "big") ^ int.from_bytes(b[:m], "big")
    return m - (x.bit_length() + 7) // 8


def lcp_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every interval of the tree, children first; lcp[i] is of entries i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp, 0]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def repeated_extents(contexts: list[tuple[bytes, bytes]], least: int) -> list[list[tuple[int, int]]]:
    """For each context (reversed left part, right part) how far to the left and right of the anchor strings go that
    another context has too, if they have ``least`` bytes; ranges within others of the same context are left out."""
    order = sorted(range(len(contexts)), key=lambda i: contexts[i][1])
    right = [contexts[i][1] for i in order]
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    for depth, first, last in lcp_intervals([common(a, b) for a, b in zip(right, right[1:], strict=False)]):
        members = sorted(order[first : last + 1], key=lambda i: contexts[i][0])
        shared = [common(contexts[a][0], contexts[b][0]) for a, b in zip(members, members[1:], strict=False)]
        for member, extent in zip(members, map(max, zip([0, *shared], [*shared, 0], strict=True)), strict=True):
            if extent + depth >= least and (not out[member] or extent > out[member][-1][0]):  # depths fall
                out[member].append((extent, depth))
    return out


def maximal_repeats(contexts: list[tuple[bytes, bytes]], least: int) -> Iterator[tuple[int, int, list[int]]]:
    """(extent to the left, depth to the right, members) of every string of at least ``least`` bytes around the anchor
    that several contexts have and that no byte on either side can be added to for all of them."""
    order = sorted(range(len(contexts)), key=lambda i: contexts[i][1])
    right = [contexts[i][1] for i in order]
    shared = [common(a, b) for a, b in zip(right, right[1:], strict=False)]
    for depth, first, last in lcp_intervals(shared):
        members = sorted(range(first, last + 1), key=lambda r: contexts[order[r]][0])
        left = [contexts[order[r]][0] for r in members]
        inner = [common(a, b) for a, b in zip(left, left[1:], strict=False)]
        for extent, a, b in [*lcp_intervals(inner), *([(0, 0, len(inner))] if min(inner) == 0 else [])]:
            ranks = members[a : b + 1]
            # right-maximal: not all members are in one interval below this one
            if extent + depth >= least and min(shared[min(ranks) : max(ranks)]) == depth:
                yield extent, depth, [order[r] for r in ranks]


def whole_words(context: bytes, a: int, b: int, begins: bool, ends: bool) -> int:
    """Words of the context that lie wholly in a to b; begins and ends: whether the text does where the context does."""
    part = context[a:b]
    n = len(part.split())
    if not part[:1].isspace() and not (context[a - 1 : a].isspace() if a else begins):
        n -= 1
    if not part[-1:].isspace() and not (context[b : b + 1].isspace() if b < len(context) else ends):
        n -= 1
    return max(n, 0)


def covered(left: bytes, right: bytes, extents: list[tuple[int, int]]) -> tuple[int, int, int, int]:
    """How far repeated strings of LENGTH bytes, and of passages too, go to the left and right of an anchor."""
    strings = [x for x in extents if sum(x) >= LENGTH]
    low, high = (max((x[i] for x in strings), default=0) for i in (0, 1))
    wide_low, wide_high = low, high
    context = None
    for extent, depth in sorted(extents, key=sum, reverse=True):
        if extent + depth < LENGTH and (extent > wide_low or depth > wide_high):
            context = context or left[::-1] + right
            if whole_words(context, len(left) - extent, len(left) + depth, len(left) < BEFORE, len(right) < AFTER) >= WORDS:
                wide_low, wide_high = max(wide_low, extent), max(wide_high, depth)
    return low, high, wide_low, wide_high


_RANGES = ("low", "high", "wide_low", "wide_high")
_RANGE_DDL = "h long, c long, " + ", ".join(f"{c} int" for c in _RANGES)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[tuple[int, int], tuple[bytes, bytes]]]:
    """Groups of contexts, which come sorted by their gram; one is held at a time."""
    held: dict[tuple[int, int], tuple[bytes, bytes]] = {}
    last = None
    for batch in batches:
        for h, c, left, context in zip(*(batch.column(x).to_pylist() for x in ("h", "c", "left", "context")), strict=True):
            if h != last and held:
                yield held
                held = {}
            last = h
            held[h, c] = (context[:left][::-1], context[left:])
    if held:
        yield held


def _in_batches(rows: Iterator[tuple], ddl: str, size: int = 5000) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [f.split() for f in ddl.split(", ")]
    held = []

    def ready():
        out = pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, (_, t) in zip(zip(*held, strict=True), fields, strict=True)], names=[n for n, _ in fields])
        held.clear()
        return out

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield ready()
    if held:
        yield ready()


def _suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for group in _groups(batches):
        contexts = list(group.values())
        for (h, c), (left, right), extents in zip(group, contexts, repeated_extents(contexts, PASSAGE), strict=True):
            if extents and any(found := covered(left, right, extents)):
                yield h, c, *found


_STRINGS = "w long, v int, h long, c long, a int, b int, wide boolean"


def _string_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings that a context's anchor stands for: hashes, range around the anchor, whether it is for its words.

    Of passages, the shortest from each place with PASSAGE bytes and over 50 whole words; its last word has to be whole
    in both texts, unlike where contexts are compared.
    """
    for batch in batches:
        for h, c, left, context in zip(*(batch.column(x).to_pylist() for x in ("h", "c", "left", "context")), strict=True):
            data = np.frombuffer(context, np.uint8)
            n = len(data)
            start = np.arange(left + 1)
            plain = start[start + LENGTH <= n]
            begun, ended = _word_counts(data, np.zeros(1, np.int64) if left < BEFORE else np.zeros(0, np.int64))
            if left == BEFORE and n and not _WS[data[0]]:
                begun[1:] -= 1  # the context begins within a word, perhaps
                ended = ended - (ended > 0)
            ends = np.flatnonzero(np.diff(ended)) + 1  # place after each whole word
            word = begun[start] + WORDS - 1
            some = start[word < len(ends)]
            stop = np.maximum(ends[begun[some] + WORDS - 1], some + PASSAGE)
            known = (stop < n) | (len(context) - left < AFTER) & (stop == n)  # a word at the context's end may go on
            some, stop = some[known], stop[known]
            a, b = np.concatenate([plain, some]), np.concatenate([plain + LENGTH, stop])
            if len(a):
                w, v = (_Hashes(data, t)(a, b) for t in _TABLES)
                columns = {"w": w.view(np.int64), "v": (v >> U64(32)).astype(np.uint32).view(np.int32), "h": np.full(len(a), h), "c": np.full(len(a), c), "a": (a - left).astype(np.int32), "b": (b - left).astype(np.int32), "wide": np.arange(len(a)) >= len(plain)}
                yield pa.RecordBatch.from_pydict({k: pa.array(x) for k, x in columns.items()})


def _hot_ranges(contexts: DataFrame) -> DataFrame:
    """Ranges of grams with many kinds of contexts, by counting their strings."""
    strings = write_table(contexts.dropDuplicates(["h", "c"]).mapInArrow(_string_batches, _STRINGS), "strings")
    key = ["h", "a", "wide", "w", "v"]  # the same string around the same anchor, so not one place seen from two anchors
    again = write_table(strings.groupBy(*key).count().filter("count > 1").select(*key), "repeated-strings")
    found = strings.join(again, key)
    plain = F.when(~F.col("wide"), F.col("a")), F.when(~F.col("wide"), F.col("b"))
    ranges = found.groupBy("h", "c").agg(*[F.coalesce(x, F.lit(0)).alias(n) for n, x in zip(_RANGES, (-F.min(plain[0]), F.max(plain[1]), -F.min("a"), F.max("b")), strict=True)])
    return ranges.select("h", "c", *_RANGES)


def _write_intervals(batches: Iterator[pa.RecordBatch], folder: str, shards: int) -> Iterator[pa.RecordBatch]:
    """Merged intervals of each document, sorted by its key, without passages and with them."""
    got = [[b.column(c).to_numpy() for c in ("dk", "ck", "a", "b", "wide_a", "wide_b")] for b in batches]
    if not got:
        return
    dk, ck, a, b, wide_a, wide_b = (np.concatenate(x) for x in zip(*got, strict=True))
    key, check, start, end = merged(dk.view(U64), ck, a, b)
    yield from _write_shards({"key": key, "check": check, "from": start, "to": end}, _top(key, shards), folder)
    key, check, start, end = merged(dk.view(U64), ck, wide_a, wide_b)
    yield from _write_shards({"wide_key": key, "wide_check": check, "wide_from": start, "wide_to": end}, _top(key, shards), folder)


def merged(key: np.ndarray, check: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of documents without overlaps, sorted; those without bytes are left out."""
    some = b > a
    key, check, a, b = key[some], check[some], a[some].astype(np.int64), b[some].astype(np.int64)
    if not len(key):
        return key, check, a, b
    order = np.lexsort((a, check, key))
    key, check, a, b = key[order], check[order], a[order], b[order]
    doc = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (check[1:] != check[:-1]))) - 1
    base = doc * (int(b.max()) + 2)  # documents one after another on a line
    end = np.maximum.accumulate(base + b)
    starts = np.flatnonzero(np.append(True, (base + a)[1:] > end[:-1]))
    last = np.append(starts[1:], len(a)) - 1
    return key[starts], check[starts], a[starts], end[last] - base[last]


def _cut_documents(batch: pa.RecordBatch, cuts: Shards) -> Iterator[tuple[np.ndarray, list[tuple[int, int]], int]]:
    """Each text's bytes, the ranges to remove and the whole words of what is removed or a passage."""
    key, check = document_keys(batch.column("text"), batch.column("doc_id"))
    data, off = text_bytes(batch.column("text"))
    keys_, shard = key.view(U64), _top(key, cuts.shards)
    for i in range(len(key)):
        s = int(shard[i])

        def ranges(prefix: str) -> list[tuple[int, int]]:
            table = cuts.get(f"{prefix}key", s, U64)
            found = range(np.searchsorted(table, keys_[i]), np.searchsorted(table, keys_[i], "right"))
            found = [r for r in found if cuts.get(f"{prefix}check", s, np.int32)[r] == check[i]]
            return [tuple(int(cuts.get(prefix + x, s, np.int64)[r]) for x in ("from", "to")) for r in found]

        text, words = data[off[i] : off[i + 1]], 0
        if wide := ranges("wide_"):
            begun, ended = _word_counts(text, np.zeros(1, np.int64))
            words = sum(max(0, int(ended[b] - begun[a])) for a, b in wide)
        yield text, ranges(""), words


def _kept(text: np.ndarray, ranges: list[tuple[int, int]]) -> Iterator[np.ndarray]:
    at = 0
    for a, b in ranges:
        yield text[at:a]
        at = b
    yield text[at:]


def _removed_batches(batches: Iterator[pa.RecordBatch], cuts: Shards) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, ranges, wide in _cut_documents(batch, cuts):
            digest = hashlib.sha256()
            for part in _kept(text, ranges):
                digest.update(part)
            rows.append((len(text), sum(b - a for a, b in ranges), len(ranges), digest.hexdigest(), wide))
        names, kinds = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        columns = {n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, kinds, strict=True))}
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | columns)


def _remaining_batches(batches: Iterator[pa.RecordBatch], cuts: Shards) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [b"".join(x.tobytes() for x in _kept(text, ranges)) for text, ranges, _ in _cut_documents(batch, cuts)]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "kept": pa.array(kept, pa.binary())})


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """Anchors whose gram occurs more than once; mixed: whether it has different contexts."""
    ship(docs.sparkSession)
    found = write_table(docs.select("doc_id", "text").mapInArrow(_anchor_batches, _ANCHORS), "anchors")
    grams = found.groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).filter("n > 1")
    grams = write_table(grams.select("h", (F.col("c0") != F.col("c1")).alias("mixed")), "grams")
    return write_table(found.join(grams, "h"), "repeated-anchors")


def _kinds_and_contexts(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The kinds of contexts (h, c) of mixed grams with their number, and one context of each with its bytes."""
    spark = docs.sparkSession
    kinds = found.filter("mixed").groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("dk", "pos")).alias("one"), *[F.first(x).alias(x) for x in ("left", "right", "wide")])
    kinds = write_table(kinds.select("h", "c", "n", "one.dk", F.col("one.pos").cast("long").alias("pos"), "left", "right", "wide"), "kinds")
    requests = _stored_requests(kinds.select("h", "c", "dk", "pos"), spark, kinds.count())
    contexts = docs.select("doc_id", "text").mapInArrow(lambda it: _context_batches(it, requests), "h long, c long, left int, context binary")
    return kinds, write_table(contexts, "contexts")


def repeated_ranges(docs: DataFrame, group: int = GROUP) -> tuple[DataFrame, int]:
    """dk, ck (a document's key), a and b: byte ranges that repeated strings cover, wide_a and wide_b: and passages too;
    ranges may overlap. The second result is about how many there are."""
    found = repeated_anchors(docs)
    kinds, contexts = _kinds_and_contexts(docs, found)
    large = write_table(contexts.groupBy("h").count().filter(F.col("count") > group).select("h"), "large", rows=0)
    hot = not large.isEmpty()
    small = contexts.join(large, "h", "left_anti") if hot else contexts
    ranges = small.repartition("h").sortWithinPartitions("h").mapInArrow(lambda it: _in_batches(_suffix_rows(it), _RANGE_DDL), _RANGE_DDL)
    if hot:
        ranges = ranges.unionByName(_hot_ranges(contexts.join(large, "h", "left_semi")))
    ranges = ranges.unionByName(_whole(kinds.filter("n > 1")))
    ranges = write_table(ranges.groupBy("h", "c").agg(*[F.max(c).alias(c) for c in _RANGES]), "ranges")
    part = found.filter("mixed").select("h", "c", "dk", "ck", "pos").join(ranges, ["h", "c"])
    equal = _whole(found.filter("not mixed"), "dk", "ck", "pos").select(*part.columns)
    ends = [(F.col("pos") + (F.col(c) if i % 2 else -F.col(c))).cast("int").alias(n) for i, (c, n) in enumerate(zip(_RANGES, ("a", "b", "wide_a", "wide_b"), strict=True))]
    return part.unionByName(equal).select("dk", "ck", *ends).filter("a < b or wide_a < wide_b"), found.count()


def _whole(rows: DataFrame, *more: str) -> DataFrame:
    """Ranges of contexts that occur several times as a whole."""
    long = F.col("left") + F.col("right") >= LENGTH
    sides = [F.when(test, F.col(side)).otherwise(0).cast("int") for test in (long, long | F.col("wide")) for side in ("left", "right")]
    return rows.select("h", "c", *more, *[s.alias(n) for s, n in zip(sides, _RANGES, strict=True)])


def _stored_requests(keyed: DataFrame, spark: SparkSession, count: int) -> Shards:
    """Requests go to the shard of their own key, which is made first."""

    def key(batches):
        for b in batches:
            k = request_keys(*(np.ascontiguousarray(b.column(c).to_numpy()) for c in ("h", "c", "dk", "pos")))
            yield pa.RecordBatch.from_pydict({"k": pa.array(k.view(np.int64))})

    def write(batches, folder, shards):
        k = np.sort(np.concatenate([np.zeros(0, np.int64), *(b.column("k").to_numpy() for b in batches)]).view(U64))
        yield from _write_shards({"request": k}, _top(k, shards), folder)

    return _stored(keyed.mapInArrow(key, "k long"), write, spark, "requests", "k", count)


def _cuts(docs: DataFrame, group: int) -> Shards:
    ranges, count = repeated_ranges(docs, group)
    return _stored(ranges, _write_intervals, docs.sparkSession, "intervals", "dk", count)


def remove_repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_passage_words of every document."""
    cuts = _cuts(docs, group)
    ddl = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long"
    return docs.select("doc_id", "text").mapInArrow(lambda it: _removed_batches(it, cuts), ddl)


def remaining(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id and the bytes that are left of every document; a cut may part a character."""
    cuts = _cuts(docs, group)
    return docs.select("doc_id", "text").mapInArrow(lambda it: _remaining_batches(it, cuts), f"doc_id {dict(docs.dtypes)['doc_id']}, kept binary")


def _repeat_rows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple]:
    for group in _groups(batches):
        names, contexts = list(group), list(group.values())
        for extent, depth, members in maximal_repeats(contexts, least):
            left, right = contexts[members[0]]
            digest = hashlib.blake2b(left[:extent][::-1] + right[:depth], digest_size=8).digest()
            for m in members:
                yield *names[m], int.from_bytes(digest, "big", signed=True), extent, depth


def repeat_groups(docs: DataFrame, least: int = LENGTH) -> DataFrame:
    """Maximal repeats of at least ``least`` bytes (PASSAGE or more) with all occurrences: repeat_id, length, doc_id, start.

    One group for each anchor and each string around it that can't be extended for all its occurrences within their
    contexts; a repeat longer than a context is output as overlapping parts. Rows that repeat a document are
    occurrences each. The kinds of contexts of one gram are compared in one task.
    """
    if least < PASSAGE:
        raise ValueError(f"repeats have {PASSAGE} bytes at least")
    found = repeated_anchors(docs)
    kinds, contexts = _kinds_and_contexts(docs, found)
    ddl = "h long, c long, repeat_id long, extent int, depth int"
    groups = contexts.repartition("h").sortWithinPartitions("h").mapInArrow(lambda it: _in_batches(_repeat_rows(it, least), ddl), ddl)
    whole = lambda rows: rows.filter(F.col("left") + F.col("right") >= least).select("h", "c", F.xxhash64("h", "c").alias("repeat_id"), F.col("left").cast("int").alias("extent"), F.col("right").cast("int").alias("depth"))
    equal = whole(found.filter("not mixed")).distinct()
    every = groups.unionByName(whole(kinds.filter("n > 1"))).unionByName(equal)
    places = found.select("h", "c", "dk", "ck", "pos").join(every, ["h", "c"])

    def named(batches):
        for batch in batches:
            key, check = document_keys(batch.column("text"), batch.column("doc_id"))
            yield pa.RecordBatch.from_pydict({"dk": pa.array(key), "ck": pa.array(check), "doc_id": batch.column("doc_id")})

    ids = docs.select("doc_id", "text").mapInArrow(named, f"dk long, ck int, doc_id {dict(docs.dtypes)['doc_id']}").distinct()
    return places.join(ids, ["dk", "ck"]).select("repeat_id", (F.col("extent") + F.col("depth")).alias("length"), "doc_id", (F.col("pos") - F.col("extent")).alias("start"))
