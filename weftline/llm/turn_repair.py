"""Repair of conversation structure by weighted finite-state composition.

Three machines: the acceptor of a conversation's rows (a symbol is a row's role initial and fault), a transducer of edits
(keep, rerole, delete, insert, with costs) and the acceptor of the role grammar. Their composition is never built: ``arcs``
gives the arcs out of one of its states on demand. Every state has at most one arc of a label, so the least of several
cheapest label strings is found by the least label of a cheapest arc at each state.

The shortest distance to the end is computed backwards, in topological order of the rows, and the path read forwards. A row's
step depends only on its symbol and the differences between the grammar states' distances, which are few, so steps are cached.
A conversation is cut into the chunks of ``turns.in_order``: a chunk's distances are a small (min, +) matrix, the matrices of
the chunks of a conversation are multiplied, and each chunk is then worked on by itself from each state in which it can be
entered. So a conversation with a third of all rows is many tasks; only the digest of a whole repaired conversation, one
sequence by nature, streams through one. Rows that repeat are found by aggregation of their digests over the conversation.

Defined results: null role, text, conv_id or turn (in the key of the damage) are one space; rows go by turn (nulls first), then role and
text after damage; rows that tie in all are alike; a row without a role initial, or with one that the grammar lacks, can't be kept;
texts may be of any length; conversations without rows after damage are in the result; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, write_table
from .turns import chunk, in_order, peek, runs, to_batches

#: The role grammar (s?(ua)+)? as an acceptor: state, role initial, next state.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ACCEPTING, STATES = (0, 3), 4
#: What rerole and insert can write.
WRITABLE = {"u": "user", "a": "assistant"}
RETOLD, DELETED, INSERTED, CUT_OFF = 2, 3, 2, 1
FAR = 1 << 40
#: Faults of a row.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
_WS = " \t\n\x0b\x0c\r"


def arcs(symbol: tuple[str, int] | None, state: int) -> Iterator[tuple[str, str, int, int]]:
    """The arcs that leave a state of the composition: label, role initial written, cost and next grammar state.

    ``symbol`` is the next row's (initial, fault), None at the end; only an insert ("I") stays before the row.
    """
    for out in WRITABLE:
        if out in GRAMMAR[state]:
            yield "I", out, INSERTED, GRAMMAR[state][out]
    if symbol is None:
        return
    initial, fault = symbol
    yield "D", "", DELETED, state
    if fault in (BLANK, DUPLICATE):
        return
    extra = CUT_OFF if fault == TRUNCATED else 0
    if initial in GRAMMAR[state]:
        yield "K", initial, extra, GRAMMAR[state][initial]
    for out in WRITABLE:
        if out in GRAMMAR[state]:
            yield "R", out, RETOLD + extra, GRAMMAR[state][out]


@lru_cache(1 << 16)
def step(symbol: tuple[str, int] | None, after: tuple[int, ...]) -> tuple[tuple[int, ...], int, tuple]:
    """Distances before a row from those after it, less their least, that least, and the way from each state.

    A way is (labels, role initials written, next state): inserts, then what happens to the row. At the end (symbol
    None) ``after`` has 0 for accepting states, and a way is inserts alone.
    """
    best = [FAR] * STATES
    if symbol is None:
        best = list(after)
    else:
        for q in range(STATES):
            best[q] = min([FAR, *(cost + after[r] for label, _, cost, r in arcs(symbol, q) if label != "I")])
    for _ in range(STATES):  # inserts lead from state to state at one place, by a positive cost
        for q in range(STATES):
            best[q] = min([best[q], *(cost + best[r] for label, _, cost, r in arcs(symbol, q) if label == "I")])
    ways = []
    for q in range(STATES):
        labels, written, state, done = "", "", q, best[q] >= FAR
        while not done:
            if symbol is None and after[state] == best[state]:
                break
            tight = [a for a in arcs(symbol, state) if a[2] + (best if a[0] == "I" else after)[a[3]] == best[state]]
            label, out, _, state = min(tight)
            labels, written = labels + label, written + (out or "-")
            done = label != "I"
        ways.append((labels, written, state))
    least = min(best)
    return tuple(min(b - least, FAR) for b in best), least, tuple(ways)


def backwards(symbols: list[tuple[str, int]], end: tuple[int, ...]) -> tuple[list[int], list[tuple]]:
    """Distances at a chunk's start from those at its end, and the ways of its rows."""
    least = min(end)
    rest, ways = tuple(min(v - least, FAR) for v in end), []
    for symbol in reversed(symbols):
        rest, more, way = step(symbol, rest)
        least += more
        ways.append(way)
    return [v + least if v < FAR else FAR for v in rest], ways[::-1]


_ACCEPT = tuple(0 if q in ACCEPTING else FAR for q in range(STATES))
#: Distances at the end of a conversation, where only inserts are left, and those inserts.
_LAST, _, END_WAYS = step(None, _ACCEPT)


def cheapest(symbols: list[tuple[str, int]]) -> list[tuple[str, str]]:
    """(labels, role initials written) for every row of a whole conversation; inserts after the last row go with it."""
    return follow(backwards(symbols, _LAST)[1], 0, True)[0]


def follow(ways: list[tuple], state: int, to_end: bool) -> tuple[list[tuple[str, str]], int]:
    out = []
    for way in ways:
        labels, written, state = way[state]
        out.append((labels, written))
    if to_end and out:
        labels, written, state = END_WAYS[state]
        out[-1] = (out[-1][0] + labels, out[-1][1] + written)
    return out, state


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone of all rows, damaged by a checksum of conv_id and turn; dropped rows stay as gone."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone in order, with seq and fault, as a written table.

    A row is a duplicate if one with its role and text is earlier in its conversation; only digests of the two are
    aggregated, and only those that occur more than once are joined.
    """
    turns = in_order(rows.select("conv_id", "turn", "role", "text", "gone"), "conv_id", "turn", "role", "text", "gone")
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    bare = F.rtrim(F.col("text"), F.lit(_WS))
    own = F.when(bare == "", BLANK).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    turns = write_table(turns.withColumns({"own": own, "digest": digest}), "turns")
    seen = turns.filter("not gone and own <> 1").groupBy("conv_id", "digest").agg(F.min("seq").alias("first"), F.count("*").alias("n")).filter("n > 1")
    seen = seen.select(F.col("conv_id").alias("s_conv"), F.col("digest").alias("s_digest"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("digest") == F.col("s_digest"))
    fault = F.when((F.col("own") != BLANK) & (F.col("seq") > F.col("first")), DUPLICATE).otherwise(F.col("own"))
    return turns.join(seen, same, "left").select("conv_id", "turn", "role", "text", "gone", "seq", fault.alias("fault"))


def _symbols(rows) -> tuple[list[int], list[tuple[str, int]]]:
    seq, symbols = [], []
    for r in rows:
        seq.append(r["seq"])
        symbols.append((r["initial"], r["fault"]))
    return seq, symbols


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk the distances from each state at its start to each at its end, row by row."""
    schema, batches = peek(batches)
    if schema is None:
        return

    def rows():
        for (conv, at), own in runs(batches, "conv_id", "chunk"):
            symbols = _symbols(own)[1]
            ends = [tuple(0 if q == r else FAR for q in range(STATES)) for r in range(STATES)]
            columns = [backwards(symbols, e)[0] for e in ends]
            yield conv, at, [columns[r][q] for q in range(STATES) for r in range(STATES)]

    yield from to_batches(rows(), pa.schema([schema.field("conv_id"), ("chunk", pa.int64()), ("matrix", pa.list_(pa.int64()))]))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk of a conversation of several the distances at its end, and whether it is the last."""
    schema, batches = peek(batches)
    if schema is None:
        return

    def rows():
        for (conv,), own in runs(batches, "conv_id"):
            for r in own:
                end = np.array(_LAST, np.int64)
                for i, c in enumerate(reversed(r["chunks"])):
                    yield conv, c["chunk"], [int(v) for v in end], i == 0, i == len(r["chunks"]) - 1
                    end = np.minimum((np.array(c["matrix"], np.int64).reshape(STATES, STATES) + end).min(axis=1), FAR)

    names = [("chunk", pa.int64()), ("end", pa.list_(pa.int64())), ("is_last", pa.bool_()), ("is_first", pa.bool_())]
    yield from to_batches(rows(), pa.schema([schema.field("conv_id"), *names]))


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of every row for each state in which its chunk can be entered, and (seq -1) the state in which it is left."""
    schema, batches = peek(batches)
    if schema is None:
        return

    def rows():
        for (conv, at), own in runs(batches, "conv_id", "chunk"):
            first = next(own)
            seq, symbols = _symbols(own)
            seq, symbols = [first["seq"], *seq], [(first["initial"], first["fault"]), *symbols]
            alone = first["end"] is None
            ways = backwards(symbols, _LAST if alone else tuple(first["end"]))[1]
            for entry in [0] if alone or first["is_first"] else range(STATES):
                edits, left = follow(ways, entry, alone or first["is_last"])
                if not alone:
                    yield conv, at, entry, -1, None, None, left
                for s, (labels, written) in zip(seq, edits, strict=True):
                    yield conv, at, entry, s, labels, written, None

    names = [("chunk", pa.int64()), ("entry", pa.int32()), ("seq", pa.int64()), ("labels", pa.string()), ("written", pa.string()), ("left", pa.int32())]
    yield from to_batches(rows(), pa.schema([schema.field("conv_id"), *names]))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, batches = peek(batches)
    if schema is None:
        return

    def rows():
        for (conv,), own in runs(batches, "conv_id"):
            for r in own:
                state = 0
                for at, exits in sorted((x["chunk"], {y["entry"]: y["left"] for y in r["exits"] if y["chunk"] == x["chunk"]}) for x in r["exits"] if x["entry"] == 0):
                    yield conv, at, state
                    state = exits[state]

    yield from to_batches(rows(), pa.schema([schema.field("conv_id"), ("chunk", pa.int64()), ("entry", pa.int32())]))


def edits(turns: DataFrame) -> DataFrame:
    """``turns`` (of ``with_faults``) with labels, the cheapest edits at each row, and written, their role initials.

    Rows that are gone have none. Only symbols are dealt out by chunk; texts aren't.
    """
    kind = dict(turns.dtypes)["conv_id"]
    facts = turns.filter("not gone").select("conv_id", "seq", chunk().alias("chunk"), F.substring("role", 1, 1).alias("initial"), F.col("fault").cast("int").alias("fault"))
    facts = write_table(facts, "facts")
    dealt = lambda df: df.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "seq")
    # conversations that are cut: at most one for each border between chunks
    cut = facts.groupBy("conv_id").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi")).filter("lo < hi").select(F.col("conv_id").alias("c_conv"))
    parts = facts.join(cut, F.col("conv_id").eqNullSafe(F.col("c_conv")), "left_semi")
    matrices = dealt(parts).mapInArrow(_matrices, f"conv_id {kind}, chunk long, matrix array<long>")
    lists = matrices.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "matrix"))).alias("chunks"))  # a row for each chunk
    ends = lists.mapInArrow(_ends, f"conv_id {kind}, chunk long, end array<long>, is_last boolean, is_first boolean")
    ends = write_table(ends.select(F.col("conv_id").alias("e_conv"), F.col("chunk").alias("e_chunk"), "end", "is_last", "is_first"), "ends", 0)
    here = lambda conv, at: F.col("conv_id").eqNullSafe(F.col(conv)) & (F.col("chunk") == F.col(at))
    known = facts.join(ends, here("e_conv", "e_chunk"), "left").drop("e_conv", "e_chunk")
    ways = dealt(known).mapInArrow(_ways, f"conv_id {kind}, chunk long, entry int, seq long, labels string, written string, left int")
    ways = write_table(ways, "ways")
    exits = ways.filter("seq < 0").groupBy("conv_id").agg(F.collect_list(F.struct("chunk", "entry", "left")).alias("exits"))  # four rows for each chunk
    entries = exits.mapInArrow(_entries, f"conv_id {kind}, chunk long, entry int")
    entries = entries.select(F.col("conv_id").alias("n_conv"), F.col("chunk").alias("n_chunk"), F.col("entry").alias("wanted"))
    taken = ways.filter("seq >= 0").join(entries, here("n_conv", "n_chunk"), "left").filter("wanted is null or entry = wanted")
    return turns.join(taken.select(F.col("seq").alias("w_seq"), "labels", "written"), F.col("seq") == F.col("w_seq"), "left").drop("w_seq")


def repaired(edited: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv_id, seq and place (their order), role and text."""
    one = F.explode(F.zip_with(F.split("labels", ""), F.sequence(F.lit(0), F.length("labels") - 1), lambda label, i: F.struct(label.alias("label"), i.alias("place"))))
    rows = edited.filter("labels is not null").select("conv_id", "seq", "role", "text", "written", one.alias("edit"))
    out = F.substring("written", F.col("edit.place") + 1, F.lit(1))
    told = F.when(out == "u", "user").otherwise("assistant")
    label = F.col("edit.label")
    rows = rows.filter(label != "D")
    return rows.select("conv_id", "seq", F.col("edit.place").alias("place"), F.when(label == "K", F.col("role")).otherwise(told).alias("role"), F.when(label == "I", "").otherwise(F.col("text")).alias("text"))


_LEGAL = ("su", "ua", "au")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, batches = peek(batches)
    if schema is None:
        return

    def rows():
        for (conv,), own in runs(batches, "conv_id"):
            sha, started, audit = hashlib.sha256(), False, []
            low = high = previous = None
            distinct = illegal = cost = 0
            faults = [0] * 4
            for r in own:
                if r["gone"]:
                    continue
                if (turn := r["turn"]) is not None:
                    distinct += turn != high
                    low, high = turn if low is None else low, turn
                faults[r["fault"]] += 1
                initial = r["role"][:1]
                illegal += previous is not None and previous + initial not in _LEGAL
                previous = initial
                audit.append(r["labels"])
                for label, out in zip(r["labels"], r["written"], strict=True):
                    cost += {"K": 0, "R": RETOLD, "D": DELETED, "I": INSERTED}[label]
                    if label == "D":
                        continue
                    cost += CUT_OFF if label != "I" and r["fault"] == TRUNCATED else 0
                    line = f"{r['role'] if label == 'K' else WRITABLE[out]}:{'' if label == 'I' else r['text']}"
                    sha.update(("\n" * started + line).encode())
                    started = True
            gaps = 0 if low is None else int(high - low) + 1 - distinct
            yield conv, gaps, faults[BLANK], faults[DUPLICATE], faults[TRUNCATED], illegal, cost, "".join(audit), sha.hexdigest()

    numbers = [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    yield from to_batches(rows(), pa.schema([schema.field("conv_id"), *numbers, ("audit", pa.string()), ("repaired_sha256", pa.string())]), 256)


def repair_digests(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation of rows
    (conv_id, turn, role, text, gone); a conversation streams through a running digest, in order."""
    ship(rows.sparkSession)
    edited = edits(with_faults(rows))
    dealt = edited.select("conv_id", "turn", "role", "text", "gone", "seq", F.col("fault").cast("int").alias("fault"), "labels", "written")
    ddl = f"conv_id {dict(rows.dtypes)['conv_id']}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return dealt.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(_digests, ddl)
