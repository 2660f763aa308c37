"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document is the sequence of its 5-word shingles, each labelled with its occurrence (the first, second, ... equal one).
For each of 24 hash functions a sketch entry keeps the four smallest labelled shingles in the order of the text, so two
documents share an entry only if they have these shingles in the same order. Documents that share an entry are
candidates. The similarity of two documents is M / (n1 + n2 - M), M being the length of the longest common subsequence
of their shingles: an order-respecting Jaccard index, computed by an alignment in the band that 0.8 allows. At a
similarity of 0.8 a pair of long texts shares no entry with a chance of about 3 in a million. Short texts have few
shingles to draw from, so those of up to 11 also have a key for each way to leave out a fifth of their shingles, which
finds every pair with a text of up to 9 shingles. No candidate is dropped otherwise.

Work never grows with the square of a hot group where it needn't: texts with equal words are one class before anything
else; then each document is aligned with the smallest one of each of its buckets; only buckets whose documents are still
in several components are compared further, in blocks of at most 256 against 256 documents, which emit links that join
components and never all pairs.

Defined results: null, empty and white-space texts have no shingles and are never linked; texts of fewer than five words
are one shingle; a null doc_id links with nothing and is kept; rows that repeat a doc_id are one document, which is linked with
what any of its texts is linked with; a doc_id has to be a number or a text
of one; a text of any length is taken whole; labelled shingles differ, so that they tie only where
hashes collide; an empty
table gives an empty result; extra columns are ignored, or passed through by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, few_files, ship, write_table
from .components import connected_components
from .textops import U64, keys, mix64, shingles, text_bytes, word_hashes

SHINGLE, ENTRIES, ORDER, SIMILARITY = 5, 24, 4, 0.8
#: Shingles up to which a text also finds its partners without chance.
SHORT = 9
#: Documents on either side of one block of comparisons.
BLOCK = 256


def doc_words(column: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text of a column."""
    data, off = text_bytes(column)
    at = 0
    while at < len(off) - 1:  # about half a megabyte at a time
        to = max(at + 1, int(np.searchsorted(off, off[at] + (1 << 19), "right")) - 1)
        part = off[at : to + 1] - off[at]
        h, s, _ = word_hashes(data[off[at] : off[to]], part)
        ends = np.searchsorted(s, part)
        for i in range(to - at):
            yield h[ends[i] : ends[i + 1]]
        at = to


def occurrences(values: np.ndarray) -> np.ndarray:
    """For each value how many equal ones stand before it."""
    order = np.argsort(values, kind="stable")
    same = np.append(False, values[order][1:] == values[order][:-1]) if len(values) else np.zeros(0, bool)
    if not same.any():
        return np.zeros(len(values), U64)
    place = np.arange(len(values))
    first = np.maximum.accumulate(np.where(same, 0, place))
    out = np.zeros(len(values), U64)
    out[order] = place - first
    return out


def labelled(values: np.ndarray) -> np.ndarray:
    return mix64(values + occurrences(values) * U64(0xA0761D6478BD642F))


def sketch(words: np.ndarray, k: int = SHINGLE, entries: int = ENTRIES, order: int = ORDER) -> np.ndarray:
    """The Order MinHash entries of a word sequence, as signed numbers; none for no words."""
    if not len(words):
        return np.zeros(0, np.int64)
    s = labelled(shingles(words, k))
    salts = keys(entries, 11)
    v = (s[None, :] ^ salts[:, None]) * U64(0x9E3779B97F4A7C15)
    v ^= v >> U64(32)
    least = min(order, len(s))
    at = np.argpartition(v, least - 1, axis=1)[:, :least] if least < len(s) else np.tile(np.arange(len(s)), (entries, 1))
    at.sort(axis=1)
    out = salts.copy()
    for j in range(least):
        out = mix64(out * U64(0xE7037ED1A0B428DB) + s[at[:, j]])
    return out.view(np.int64)


def subsequence_keys(words: np.ndarray, k: int = SHINGLE, similarity: float = SIMILARITY) -> np.ndarray:
    """For a text of few shingles a key for each way to leave out so many of them as a similar text may lack.

    Two texts of which one has at most SHORT shingles share a key if their similarity is reached, whatever the sketch
    has found. None for longer texts.
    """
    n = max(len(words) - k + 1, min(len(words), 1))
    if not n or n > int(SHORT / similarity + 1e-9):
        return np.zeros(0, np.int64)
    s, salt = shingles(words, k), keys(n, 12)
    out = []
    for left_out in range(int((1 - similarity) * n + 1e-9) + 1):
        for some in combinations(range(n), left_out):
            rest = np.delete(s, some)
            out.append(int(np.sum(mix64(rest ^ salt[: len(rest)]), dtype=U64)) ^ len(rest))
    return np.unique(np.array(out, U64)).view(np.int64)


def short_shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Shingles as 32-bit numbers, for alignment: a chance match moves a similarity by one shingle at most."""
    return (shingles(words, k) >> U64(32)).astype(np.uint32)


def needed(n1: int, n2: int, similarity: float = SIMILARITY) -> int:
    """The least M with M / (n1 + n2 - M) >= similarity."""
    return int(np.ceil(similarity * (n1 + n2) / (1 + similarity) - 1e-9))


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the longest common subsequence of a and b reaches the similarity, by dynamic programming in the band
    of diagonals that can still reach it."""
    n1, n2 = len(a), len(b)
    need = needed(n1, n2, similarity)
    if not n1 or not n2 or need > min(n1, n2):
        return False
    m = min(n1, n2)
    differ = np.flatnonzero(a[:m] != b[:m])
    head = int(differ[0]) if len(differ) else m
    a, b, m = a[head:], b[head:], m - head
    differ = np.flatnonzero(a[len(a) - m :][::-1] != b[len(b) - m :][::-1])
    tail = int(differ[0]) if len(differ) else m
    a, b, need = a[: len(a) - tail], b[: len(b) - tail], need - head - tail
    if need <= 0:
        return True
    if need > min(len(a), len(b)):
        return False
    down, right = len(a) - need, len(b) - need  # shingles of a or b that may stay unmatched
    width = down + right + 1
    # cell j of row i stands for b index i - down + j; the row holds the best length with a[:i] and b up to there
    row = np.zeros(width + 1, np.int32)
    padded = np.full(len(b) + 2 * width + 2, -1, np.int64)
    padded[width : width + len(b)] = b
    wide = a.astype(np.int64)
    for i in range(len(a)):
        lo = i - down + width
        new = row[:width] + (padded[lo : lo + width] == wide[i])  # the diagonal keeps its place in the band
        np.maximum(new, row[1:], out=new)  # a[i] unmatched: the same b index is one place to the right in the row above
        np.maximum.accumulate(new, out=new)
        row[:width] = new
        row[width] = 0
        if new[-1] + len(a) - i - 1 < need:
            return False
    return bool(row[:width].max() >= need)


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = keys(2, 13)
    for batch in batches:
        key, entries = [], []
        for words in doc_words(batch.column("text")):
            place = np.arange(len(words), dtype=U64)
            both = [int(np.sum(mix64((words ^ s) + place * U64(0x2545F4914F6CDD1D)), dtype=U64)) for s in salt]
            key.append(both[0].to_bytes(8, "big") + both[1].to_bytes(8, "big") if len(words) else None)
            entries.append(np.concatenate([sketch(words), subsequence_keys(words)]))
        flat = np.concatenate(entries) if entries else np.zeros(0, np.int64)
        off = np.cumsum([0, *map(len, entries)]).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"id": batch.column("doc_id"), "words_key": pa.array(key, pa.binary()), "sketch": pa.ListArray.from_arrays(off, flat)})


def _shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            rows = [short_shingles(w).tobytes() for w in doc_words(part.column("text"))]
            yield pa.RecordBatch.from_pydict({"id": part.column("doc_id"), "seq": pa.array(rows, pa.binary())})


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [aligned(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)) for x, y in zip(batch.column("seq_a"), batch.column("seq_b"), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def block_links(ids: np.ndarray, comps: np.ndarray, seqs: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links between documents of different components, enough to join all that can be joined within the block.

    The number of common labelled shingles bounds the alignment from above, so that only pairs that reach it are
    aligned, the most similar first; pairs that are joined already are left out.
    """
    n = len(ids)
    size = np.array([len(s) for s in seqs])
    owner = np.repeat(np.arange(n), size)
    every, column, count = np.unique(np.concatenate([labelled(s.astype(U64)) for s in seqs]), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    number = np.cumsum(count > 1) - 1
    owner, column = owner[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        i, j = np.searchsorted(column, [at, at + 4096])
        x = np.zeros((n, 4096), np.float32)
        x[owner[i:j], column[i:j] - at] = 1
        common += x @ x.T
    total = size[:, None] + size[None, :]
    a, b = np.nonzero(np.triu(common >= np.ceil(similarity * total / (1 + similarity) - 1e-9), 1))
    near = comps[a] != comps[b]
    a, b = a[near], b[near]
    best = np.argsort(-(common[a, b] / total[a, b]), kind="stable")
    groups = _Union(n)
    first: dict[int, int] = {}
    for i, c in enumerate(comps.tolist()):
        groups.join(i, first.setdefault(c, i))
    out = []
    for i, j in zip(a[best].tolist(), b[best].tolist(), strict=True):
        if groups.find(i) != groups.find(j) and aligned(seqs[i], seqs[j], similarity):
            groups.join(i, j)
            out.append((int(ids[i]), int(ids[j])))
    return out


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks come sorted by their key; a block is held at a time."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[dict] = []

    def flush():
        if len(held) > 1:
            links = block_links(np.array([r["id"] for r in held]), np.array([r["comp"] for r in held]), [np.frombuffer(r["seq"], np.uint32) for r in held])
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], schema=schema)
        held.clear()

    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["bucket"], row["i"], row["j"]) != (held[0]["bucket"], held[0]["i"], held[0]["j"]):
                yield from flush()
            held.append(row)
    yield from flush()


def text_nodes(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with __node, what is compared, and whether a doc_id repeats.

    A node is a doc_id, or, where several rows have one, a hash of it and the row's text; null without a doc_id. Only ids
    are aggregated; those that repeat are joined.
    """
    own = F.col("doc_id").cast("long")
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__repeated"))
    repeated = write_table(repeated, "repeated")
    if repeated.isEmpty():
        return docs.withColumn("__node", own), False
    marked = docs.join(repeated, F.col("doc_id") == F.col("__repeated"), "left")
    return marked.withColumn("__node", F.when(F.col("__repeated").isNull(), own).otherwise(F.xxhash64("doc_id", "text"))).drop("__repeated"), True


def node_classes(nodes: DataFrame, same: DataFrame | None = None) -> DataFrame:
    """(id, class_id) of every node that has words: the smallest node linked with it directly or over others; ``same`` has
    further links (a, b)."""
    spark = nodes.sparkSession
    ship(spark)
    text = nodes.select(F.col("__node").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    sketches = write_table(text.mapInArrow(_sketch_batches, "id long, words_key binary, sketch array<long>").filter("words_key is not null"), "sketches")
    most = ENTRIES * sketches.count()  # narrow rows in any of the tables below
    # a table of its own: Spark splits the partition of a hot key only in joins of what has been shuffled for them
    classes = write_table(sketches.groupBy("words_key").agg(F.min("id").alias("rep")), "classes", most // ENTRIES)
    reps = sketches.join(classes, "words_key").filter("id = rep").select("id", "sketch")
    entries = reps.select("id", F.posexplode("sketch").alias("t", "value")).select("id", F.xxhash64(F.least("t", F.lit(ENTRIES)), "value").alias("bucket"))
    entries = write_table(entries, "entries", most)
    hubs = entries.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter("hub <> last")
    shared = write_table(entries.join(hubs.select("bucket", "hub"), "bucket"), "shared", most)  # buckets with several documents

    wanted = shared.select(F.col("id").alias("want")).distinct()
    seqs = text.join(wanted, text.doc_id == wanted.want).select("doc_id", "text").mapInArrow(_shingle_batches, "id long, seq binary").dropDuplicates(["id"])  # of a node, so equal texts
    seqs = write_table(seqs, "shingles")
    pairs = shared.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    one, two = (seqs.select(F.col("id").alias(c), F.col("seq").alias(f"seq_{c}")) for c in "ab")
    star = pairs.join(two, "b").join(one, "a").select("a", "b", "seq_a", "seq_b").mapInArrow(_verified, "a long, b long")
    star = write_table(star.repartition(few_files(spark, most)), "star")

    placed = shared.select("bucket", "id").join(connected_components(star, most), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("comp"))
    placed = write_table(placed, "placed", most)
    split = placed.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("n")).filter("c0 <> c1")
    parts = split.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    blocks = placed.join(parts, "bucket").withColumn("own", F.pmod(F.xxhash64("id", "bucket"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    blocks = blocks.select("bucket", "id", "comp", "own", other).select("bucket", "id", "comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    blocks = blocks.join(seqs, "id").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    more = blocks.mapInArrow(_block_batches, "a long, b long")
    links = star.unionByName(more.repartition(few_files(spark, most)))
    member = sketches.select("id", "words_key").join(classes, "words_key").select("id", "rep").distinct()
    if same is not None:
        rep_of = member.withColumnRenamed("id", "m")
        for end in "ab":  # links between nodes hold for what represents them
            same = same.join(rep_of, F.col(end) == F.col("m")).drop("m", end).withColumnRenamed("rep", end)
        links = links.unionByName(same.select("a", "b"))
    comps = connected_components(links, most)
    return member.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("class_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and kept (doc_id = class_id), one row for each row of ``docs``; without words a document is its own class.

    All texts of a repeated doc_id belong to one document, so what one of them is linked with is linked with the others.
    """
    nodes, repeated = text_nodes(docs.select("doc_id", "text"))
    if not repeated:
        found = node_classes(nodes).withColumnRenamed("id", "__id")
    else:
        own = write_table(nodes.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "__node", "text").filter(F.col("text").rlike(WORD)).select("doc_id", "__node").distinct(), "nodes")
        hubs = own.groupBy("doc_id").agg(F.min("__node").alias("a"), F.max("__node").alias("b")).filter("a <> b")
        same = own.join(hubs.select("doc_id", "a"), "doc_id").select("a", F.col("__node").alias("b")).filter("a <> b")
        classes = own.join(node_classes(nodes, same).withColumnRenamed("id", "__node"), "__node").select("doc_id", "class_id").distinct()
        names = classes.groupBy("class_id").agg(F.min("doc_id").alias("least"))  # nodes aren't ids
        found = classes.join(names, "class_id").select(F.col("doc_id").alias("__id"), F.col("least").alias("class_id"))
    out = docs.select("doc_id").join(found, F.col("doc_id") == F.col("__id"), "left")
    class_id = F.coalesce("class_id", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce(class_id == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class of texts, that of the least doc_id.

    Rows that repeat a doc_id are decided by their own texts: one of equal texts stays, and a text that no other is near
    stays whatever another of its id is near. Rows with a null doc_id stay.
    """
    nodes, repeated = text_nodes(docs)
    classes = node_classes(nodes)
    if not repeated:
        return docs.join(classes.filter("id <> class_id").select(F.col("id").alias("doc_id")), "doc_id", "left_anti").select(*docs.columns)
    own = nodes.filter("__node is not null").groupBy("__node").agg(F.min(F.col("doc_id").cast("long")).alias("__own"))
    placed = write_table(classes.withColumnRenamed("id", "__node").join(own, "__node"), "placed")
    stays = placed.groupBy("class_id").agg(F.min(F.struct("__own", "__node")).alias("stays"))
    gone = placed.join(stays, "class_id").filter("__node <> stays.__node").select("__node")
    kept = nodes.join(gone, "__node", "left_anti")
    twice = write_table(kept.filter("__node is not null").groupBy("__node").count().filter("count > 1").select("__node"), "twice")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    once = kept.join(twice, "__node", "left_semi").groupBy("__node").agg(F.min(F.struct("doc_id", "text", *rest)).alias("__least"))  # combined before the shuffle
    return kept.join(twice, "__node", "left_anti").select(*docs.columns).unionByName(once.select("__least.*").select(*docs.columns))
