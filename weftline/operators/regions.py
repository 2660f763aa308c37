"""Connected regions as components of runs, in blocks that are joined at their seams.

An image is cut into blocks of BLOCK by BLOCK pixels, each of which is a group of its own; no group is an image. Within a block
marked pixels of a line make runs, overlapping runs of neighbouring lines are linked, and links are contracted to
components, many blocks at once as arrays. A component that touches the image's border is flooded. Where images are larger than a
block, components that touch a seam are nodes of a graph over all images, whose edges are the pairs of marked pixels on both
sides of a seam. That graph is contracted by super-blocks of 16 by 16 blocks, each a task, then super-blocks of what is left of these:
an image of 4096 by 4096 pixels is one level, one of a million by a million three.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: Side of a block; at most 256, as a component's name within a block has 16 bits.
BLOCK = 256
#: Blocks of a super-block's side, as a power of two.
SUPER_BITS = 4
#: Rows that are worked on together, at least.
STEP = 1 << 17


def contract(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node connected with each of n nodes, by hooking roots to smaller ones and halving paths."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return root


def run_components(line: np.ndarray, x: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """For cells sorted by line and x: the run of each, and the first run of each run's component.

    Lines are numbered block by block, ``block`` to each, so that a block's first line is no neighbour of what stands before it.
    """
    start = np.append(True, (line[1:] != line[:-1]) | (x[1:] != x[:-1] + 1)) if len(x) else np.zeros(0, bool)
    run = np.cumsum(start) - 1
    first = np.flatnonzero(start)
    last = np.append(first[1:] - 1, len(x) - 1) if len(first) else first
    own, x0, x1 = line[first], x[first], x[last]
    width = int(x.max(initial=0)) + 1
    above = (own - 1) * width  # runs of the line above that end at x0 or later and start at x1 or before
    lo = np.searchsorted(own * width + x1, above + x0, "left")
    hi = np.searchsorted(own * width + x0, above + x1, "right")
    n = np.where(own % block > 0, np.maximum(hi - lo, 0), 0)
    here = np.repeat(np.arange(len(first)), n)
    there = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return run, contract(len(first), here, there)


def _blocks(batches: Iterator[pa.RecordBatch], keys: list[str], block: int) -> Iterator[pa.RecordBatch]:
    """Pixels sorted by keys, block, y, x and filler, with gone and node; whole blocks at a time."""
    held: list[pa.RecordBatch] = []
    names = [*keys, "by", "bx"]

    def work(table: pa.Table):
        x, y, by, bx = (table.column(c).to_numpy() for c in ("x", "y", "by", "bx"))
        marks = [table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("hit", "edge", "seam")]
        new = np.zeros(len(x), bool)
        new[0] = True
        for c in names:
            column = table.column(c).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        # one pixel of a place, a filler last
        keep = np.append(True, new[1:] | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
        group = np.cumsum(new) - 1
        hit = np.flatnonzero(marks[0] & keep)
        lx, ly = x[hit] - bx[hit] * block, y[hit] - by[hit] * block
        run, root = run_components(group[hit] * block + ly, lx, block)
        of = root[run] if len(hit) else run
        edge, seam = (np.bincount(of, m[hit], len(root)).astype(bool)[of] if len(hit) else np.zeros(0, bool) for m in marks[1:])
        gone, node = np.zeros(len(x), bool), np.full(len(x), -1, np.int64)
        gone[hit] = edge
        if len(hit):
            first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))[of]  # the first cell of the component's first run
            name = ((by[hit].astype(np.int64) << 16 | bx[hit]) << 16 | ly[first] * block + lx[first]) + 1
            node[hit] = np.where(seam, name, -1)
        columns = {c: table.column(c).combine_chunks().filter(pa.array(keep)) for c in (*keys, "x", "y", "c")}
        found = {"gone": pa.array(gone[keep]), "node": pa.array(node[keep])}
        yield from pa.Table.from_pydict(columns | found).to_batches(max_chunksize=1 << 16)

    n = 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n < STEP:
            continue
        table = pa.Table.from_batches(held)
        same = np.ones(n, bool)
        for c in names:
            column = table.column(c).to_numpy()
            same &= column == column[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last block may go on
        if cut:
            yield from work(table.slice(0, cut))
        held, n = table.slice(cut).to_batches(), n - cut
    if n:
        yield from work(pa.Table.from_batches(held))


def _links(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Links sorted by keys and super-block; for each of its nodes that isn't the least of its component, that one."""
    names = [*keys, "sy", "sx"]
    held: list[pa.RecordBatch] = []

    def work():
        table = pa.Table.from_batches(held)
        nodes, at = np.unique(np.concatenate([table.column(c).to_numpy() for c in "uv"]), return_inverse=True)
        root = contract(len(nodes), *at.reshape(2, -1))
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        one = pa.array(np.zeros(len(moved), np.int64))
        columns = {k: table.column(k).combine_chunks().take(one) for k in keys}
        return pa.RecordBatch.from_pydict(columns | {"node": pa.array(nodes[moved]), "root": pa.array(nodes[root[moved]])})

    last = None
    for batch in batches:
        new = np.zeros(len(batch), bool)
        for c in names:
            column = batch.column(c).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), len(batch)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if x == y:
                continue
            own = tuple(batch.column(c)[x].as_py() for c in names)
            if held and own != last:
                yield work()
                held.clear()
            last = own
            held.append(batch.slice(x, y - x))
    if held:
        yield work()


def merged(links: DataFrame, *keys: str) -> list[DataFrame]:
    """Tables (keys, node, root) that take the nodes of links (keys, u, v) to the least ones they are connected with, one after the other.

    Links within a super-block of 16 by 16 blocks are contracted in one task, whose size the super-block bounds; the
    others are set between roots, and super-blocks of these follow, up to the whole image: 16 blocks a side to a level.
    """
    by, tables, bits = list(keys), [], 0
    while True:
        bits += SUPER_BITS
        block = lambda n, d, k=bits: F.shiftright(F.shiftright(F.col(n) - 1, 16 + d).bitwiseAND(F.lit(65535)), k)
        placed = links.withColumns({"sy": block("u", 16), "sx": block("u", 0), "ty": block("v", 16), "tx": block("v", 0)})
        inside = (F.col("sy") == F.col("ty")) & (F.col("sx") == F.col("tx"))
        names = [*by, "sy", "sx"]
        dealt = placed.filter(inside).select(*names, "u", "v").repartition(*names).sortWithinPartitions(*names)
        kinds = dict(links.dtypes)
        ddl = ", ".join([*(f"{k} {kinds[k]}" for k in by), "node long", "root long"])
        table = written(dealt.mapInArrow(lambda it: _links(it, by), ddl), "roots")
        tables.append(table)
        rest = placed.filter(~inside).select(*by, "u", "v")
        if bits >= 16 or rest.isEmpty():
            return tables
        for end in "uv":
            rest = rooted(rest, end, [table], by)
        links = written(rest.filter("u <> v").distinct(), "links")


def rooted(rows: DataFrame, column: str, tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """``rows`` with the node in ``column`` taken to its root."""
    for table in tables:
        own = table.withColumnRenamed("node", column)
        rows = rows.join(own, [*keys, column], "left").withColumn(column, F.coalesce("root", column)).drop("root")
    return rows


def _sides(mx: Column, my: Column, block: int) -> tuple[Column, Column]:
    """Whether a pixel is on its image's border, and whether it is on a seam between blocks."""
    x, y, last = F.col("x"), F.col("y"), block - 1
    edge = (x == 0) | (y == 0) | (x == mx) | (y == my)
    seam = ((x % block == last) & (x < mx)) | ((x % block == 0) & (x > 0)) | ((y % block == last) & (y < my)) | ((y % block == 0) & (y > 0))
    return edge, seam


def flood(marked: DataFrame, *keys: str, wide: bool = True, block: int = BLOCK, tasks: int | None = None) -> DataFrame:
    """keys, x, y, c and gone of marked (keys, x, y, c, hit, filler, mx, my): pixels that are connected with the border over hits are 0.

    ``mx`` and ``my`` are the last column and line of what ``keys`` (numbers) name. One pixel of a place counts, a filler last. ``wide`` may be false only where nothing is larger than a block; then one shuffle is all.
    ``tasks`` is how many tasks blocks are dealt to, for callers that know how many pixels there are.
    """
    edge, seam = _sides(F.col("mx"), F.col("my"), block)
    b = [F.floor(F.col(a) / block).cast("int").alias(f"b{a}") for a in "yx"]
    p = marked.select(*keys, *b, "x", "y", "c", "hit", edge.alias("edge"), seam.alias("seam"), "filler")
    names = [*keys, "by", "bx"]
    dealt = p.repartition(*([tasks] if tasks else []), *names).sortWithinPartitions(*names, "y", "x", "filler").drop("filler")
    kinds = dict(marked.dtypes)
    ddl = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "x int", "y int", f"c {kinds['c']}", "gone boolean", "node long"])
    found = dealt.mapInArrow(lambda it: _blocks(it, list(keys), block), ddl)
    zero = F.lit(0).cast(kinds["c"])
    if not wide:
        return found.select(*keys, "x", "y", F.when(F.col("gone"), zero).otherwise(F.col("c")).alias("c"), "gone")
    found = written(found, "blocks")
    ends = found.filter("node >= 0").select(*keys, "x", "y", F.col("node").alias("u"))
    edges = None
    for axis in "xy":
        other = "y" if axis == "x" else "x"
        before = ends.filter(F.col(axis) % block == block - 1).select(*keys, other, (F.col(axis) + 1).alias(axis), F.col("u").alias("v"))
        pairs = ends.filter(F.col(axis) % block == 0).join(before, [*keys, "x", "y"]).select(*keys, "u", "v").distinct()
        edges = pairs if edges is None else edges.unionByName(pairs)
    nodes = found.filter("node >= 0").groupBy(*keys, "node").agg(F.max("gone").alias("seed"))  # a component's pixels are alike
    roots = merged(written(edges, "links"), *keys)
    placed = rooted(nodes.withColumn("root_node", F.col("node")), "root_node", roots, list(keys))
    seeds = placed.filter("seed").select(*keys, "root_node").distinct()
    wet = placed.join(seeds, [*keys, "root_node"], "left_semi").select(*keys, "node", F.lit(True).alias("wet"))
    reached = F.col("gone") | F.coalesce("wet", F.lit(False))
    inner = found.filter("node < 0").select(*keys, "x", "y", F.when(F.col("gone"), zero).otherwise(F.col("c")).alias("c"), "gone")
    open_ = found.filter("node >= 0").join(wet, [*keys, "node"], "left")  # a node has the pixels of a block at most
    return inner.unionByName(open_.select(*keys, "x", "y", F.when(reached, zero).otherwise(F.col("c")).alias("c"), reached.alias("gone")))
