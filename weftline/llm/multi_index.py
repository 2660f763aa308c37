"""Near-duplicate embeddings by an inverted multi-index.

Each half of the (normalised) vectors has a codebook of its own; the pairs of codes form a grid of cells. Every vector
is stored in its cell. As a query a vector visits cells by the multi-sequence traversal, in the order of the summed
squared distances of its halves to the codes, until the distance in excess of its nearest cell passes a bound. The bound
is calibrated for a target recall at the very threshold: partners at exactly that cosine are drawn around sample vectors
and the bound is the quantile of the excess that the partner's cell has. A pair is found if either of its vectors visits
the other's cell, and is verified by cosine in double precision.

Codebooks and bound are fitted on a bounded sample of at most SAMPLE vectors (those of the smallest hashed ids); all
vectors are indexed. Equal vectors of a label are one class before the search. A cell is compared in blocks of at most
about BLOCK vectors a side, whose tasks emit each vector's number of partners and a spanning forest of the links, never
all pairs.

Defined results: vectors that are null, empty, zero, or have null or non-finite components, and vectors without a label,
link with nothing; vectors of different lengths are never compared; rows that repeat a vector count as further vectors; a
null vec_id is kept without links; a cosine of exactly the threshold is a link; cells of equal distance are visited
in the order of their codes; an empty table gives an empty result; extra columns are ignored. Ids and labels are whole
numbers, of any width; text is an error where it isn't one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, write_table
from .components import connected_components
from .order_minhash import _Union

SAMPLE, BLOCK = 8192, 1024
RECALL = 0.99


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((c**2).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        for i in range(len(c)):
            if (own := x[near == i]).size:
                c[i] = own.mean(0)
    return c


def code_distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances, the same for a row whatever rows come with it."""
    return np.stack([((x - c) ** 2).sum(1) for c in codes], axis=1)


def multi_sequence(d1: np.ndarray, d2: np.ndarray, excess: float) -> list[tuple[int, int]]:
    """Cells (i, j) in the order of d1[i] + d2[j], up to ``excess`` above the least."""
    o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    a, b = d1.tolist(), d2.tolist()
    limit = a[o1[0]] + b[o2[0]] + excess
    heap, out = [(a[o1[0]] + b[o2[0]], 0, 0)], []
    while heap:
        s, i, j = heapq.heappop(heap)
        if s > limit:
            break
        out.append((o1[i], o2[j]))
        if j + 1 < len(o2):
            heapq.heappush(heap, (a[o1[i]] + b[o2[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(o1):
            heapq.heappush(heap, (a[o1[i + 1]] + b[o2[0]], i + 1, 0))
    return out


class Index:
    """Codebooks for vectors of one length, and the bound of the traversal."""

    def __init__(self, x: np.ndarray, largest: int, cosine: float, recall: float = RECALL, per_cell: int = 64, seed: int = 5):
        self.half = x.shape[1] // 2
        k = int(np.clip(round((largest / per_cell) ** 0.5), 1, 1024))
        self.codes = [kmeans(h, k, seed=seed) if h.shape[1] else np.zeros((1, 0)) for h in (x[:, : self.half], x[:, self.half :])]
        rng = np.random.default_rng(seed)
        base = x[rng.choice(len(x), min(len(x), 2048), replace=False)]
        side = rng.standard_normal(base.shape)
        side -= (side * base).sum(1, keepdims=True) * base
        side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
        partner = cosine * base + (1 - cosine**2) ** 0.5 * side
        (p1, p2), (q1, q2) = self.distances(base), self.distances(partner)
        rows = np.arange(len(base))
        over = p1[rows, q1.argmin(1)] - p1.min(1) + p2[rows, q2.argmin(1)] - p2.min(1)
        back = q1[rows, p1.argmin(1)] - q1.min(1) + q2[rows, p2.argmin(1)] - q2.min(1)
        self.excess = float(np.quantile(np.minimum(over, back), recall))  # either direction finds the pair

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return code_distances(x[:, : self.half], self.codes[0]), code_distances(x[:, self.half :], self.codes[1])

    def visits(self, x: np.ndarray) -> list[list[int]]:
        """For each vector the cells that it visits, its own first."""
        n2 = len(self.codes[1])
        return [[i * n2 + j for i, j in multi_sequence(a, b, self.excess)] for a, b in zip(*self.distances(x), strict=True)]

    def visits_cell(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Whether vector r visits cell c, for all r and c."""
        d1, d2 = self.distances(x)
        n2 = len(self.codes[1])
        s = d1[:, cells // n2] + d2[:, cells % n2]
        return s <= (d1.min(1) + d2.min(1) + self.excess)[:, None]


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def valid(column: str = "embedding"):
    """Rows whose vector can link: all components finite, not all zero."""
    fine = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return F.col(column).isNotNull() & fine & F.exists(column, lambda v: v != 0)


def _matrix(column: pa.Array, kind: str = "<f8") -> np.ndarray:
    """Vectors of one length, in double precision, from a list column or from a binary one of ``kind`` numbers."""
    if pa.types.is_binary(column.type):
        data = b"".join(column.to_pylist())
        return np.frombuffer(data, kind).astype(np.float64).reshape(len(column), -1)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _visit_batches(batches: Iterator[pa.RecordBatch], indexes: dict[int, Index], kind: str) -> Iterator[pa.RecordBatch]:
    """Each vector to every cell that it visits, as a query, and to its own cell as a member."""
    for batch in batches:
        for at in range(0, len(batch), 1000):
            part = batch.slice(at, 1000)
            dims = part.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = part.filter(pa.array(dims == dim))
                x = _matrix(own.column("embedding"))
                visits = indexes[int(dim)].visits(unit(x))
                n = np.array([len(v) for v in visits])
                vectors = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
                take = pa.array(np.repeat(np.arange(len(own)), n))
                cells = np.array([c for v in visits for c in v], np.int64)
                home = np.repeat([v[0] for v in visits], n).astype(np.int64)
                columns = {c: own.column(c).take(take) for c in ("label", "dim", "id", "size")}
                yield pa.RecordBatch.from_pydict(columns | {"cell": pa.array(cells), "home": pa.array(home), "vector": vectors.take(take)})


def block_counts(index: Index, cosine: float, q: dict[str, np.ndarray], m: dict[str, np.ndarray]) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Partners' number by vector and a spanning forest of the links between queries q and the members m of a cell."""
    hit = unit(q["x"]) @ unit(m["x"]).T >= cosine
    i, j = np.nonzero(hit)
    other = q["id"][i] != m["id"][j]
    i, j = i[other], j[other]
    if not len(i):
        return {}, []
    # a pair that its other direction finds too counts in one of them only
    homes, at = np.unique(q["home"][i], return_inverse=True)
    rows, row_at = np.unique(j, return_inverse=True)
    back = index.visits_cell(unit(m["x"][rows]), homes)[row_at, at]
    once = ~back | (q["id"][i] < m["id"][j])
    i, j = i[once], j[once]
    counts: dict[int, int] = {}
    for ids, sizes in ((q["id"][i], m["size"][j]), (m["id"][j], q["size"][i])):
        keys, where = np.unique(ids, return_inverse=True)
        for k, v in zip(keys.tolist(), np.bincount(where, sizes).astype(np.int64).tolist(), strict=True):
            counts[k] = counts.get(k, 0) + v
    names = np.unique(np.concatenate([q["id"][i], m["id"][j]]))
    union = _Union(len(names))
    pairs = zip(np.searchsorted(names, q["id"][i]).tolist(), np.searchsorted(names, m["id"][j]).tolist(), strict=True)
    return counts, [(int(names[a]), int(names[b])) for a, b in pairs if union.join(a, b)]


def _block_batches(batches: Iterator[pa.RecordBatch], indexes: dict[int, Index], cosine: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Blocks come sorted by their key; one is held at a time."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
    held: list[pa.RecordBatch] = []

    def flush():
        block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        side = block.column("member").to_numpy(zero_copy_only=False)
        parts = []
        for is_member in (False, True):
            own = block.filter(pa.array(side == is_member))
            if not len(own):
                return
            parts.append({"id": own.column("id").to_numpy(), "size": own.column("size").to_numpy(), "home": own.column("home").to_numpy(), "x": _matrix(own.column("vector"), kind)})
        counts, links = block_counts(indexes[block.column("dim")[0].as_py()], cosine, *parts)
        if counts:
            rows = [(k, None, v) for k, v in counts.items()] + [(a, b, 0) for a, b in links]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=schema)

    names = ["label", "dim", "cell", "mb", "qb"]
    last = None
    for batch in batches:
        key = np.stack([batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in names], axis=1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            if a == b:
                continue
            if last is not None and (key[a] != last).any():
                yield from flush()
                held.clear()
            last = key[a]
            held.append(batch.slice(int(a), int(b - a)))
    if held:
        yield from flush()


def similar_vectors(vectors: DataFrame, cosine: float = 0.93, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    spark = vectors.sparkSession
    ship(spark)
    # floats travel as they are; comparisons are in double precision in any case
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    base = vectors.filter(valid() & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    base = base.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.size("embedding").alias("dim"), "embedding")
    base = base.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.reverse("embedding"))})
    classes = base.groupBy("label", "dim", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.min_by("embedding", "vec_id").alias("embedding"))
    classes = write_table(classes.select("label", "dim", "h1", "h2", F.col("rep").alias("id"), "size", "embedding"), "classes")

    indexes: dict[int, Index] = {}
    largest = classes.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("n")).collect()  # a row for each vector length
    for dim, n in largest:
        if n > 0:
            few = max(64, min(sample, (1 << 23) // dim))
            chosen = classes.filter(F.col("dim") == dim).orderBy(F.md5(F.col("id").cast("string"))).limit(few).select("embedding").toPandas()["embedding"]
            indexes[dim] = Index(unit(np.stack(chosen.to_list())), n, cosine, recall)
    shared = spark.sparkContext.broadcast(indexes)  # two codebooks of at most 1024 codes for each length

    visits = classes.select("label", "dim", "id", "size", F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"))
    visits = visits.mapInArrow(lambda it: _visit_batches(it, shared.value, kind), "label long, dim int, id long, size long, cell long, home long, vector binary")
    visits = write_table(visits, "visits")
    places = ["label", "dim", "cell"]
    parts = visits.groupBy(*places).agg(F.ceil(F.count("*") / BLOCK).alias("qbs"), F.greatest(F.ceil(F.count_if(F.col("cell") == F.col("home")) / BLOCK), F.lit(1)).alias("mbs"))
    rows = visits.join(parts, places)
    salt = F.xxhash64("id")
    query = rows.select(*places, "id", "size", "home", "vector", F.lit(False).alias("member"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("mbs") - 1)).alias("mb"), F.pmod(salt, "qbs").alias("qb"))
    member = rows.filter("cell = home").select(*places, "id", "size", "home", "vector", F.lit(True).alias("member"), F.pmod(salt, "mbs").alias("mb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("qbs") - 1)).alias("qb"))
    blocks = query.unionByName(member).repartition(*places, "mb", "qb").sortWithinPartitions(*places, "mb", "qb")
    found = write_table(blocks.mapInArrow(lambda it: _block_batches(it, shared.value, cosine, kind), "a long, b long, n long"), "found")
    comps = connected_components(found.filter("b is not null").select("a", "b")).withColumnRenamed("id", "c_id")
    partners = found.groupBy(F.col("a").alias("n_id")).agg(F.sum("n").alias("n"))
    reps = classes.join(comps, F.col("id") == F.col("c_id"), "left").join(partners, F.col("id") == F.col("n_id"), "left")
    reps = reps.select("label", "dim", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    member = base.join(reps, ["label", "dim", "h1", "h2"]).select(F.col("vec_id").alias("m_id"), "n_links", "component_id").distinct()
    out = vectors.select("vec_id").join(member, F.col("vec_id") == F.col("m_id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
