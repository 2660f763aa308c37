"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within each source the keys are range-sorted: the leading digits of the key deal
a source over 4096 buckets, whose sums (combined before the shuffle) give each bucket's offset; only the bucket in which
the source's budget ends is sorted by key, to find where. So a task holds 1 in 4096 of a source's rows at most, and a
source with a third of all rows is split as finely as any other. Budgets above the source's size repeat it for whole
epochs. Targets are computed from one row for each source, in one task.

Defined results: null or empty text has size 0 and takes 0; a text of any length counts whole; a null source is a source of its own (ordered last); a source
without words has target 0; repeated rows (same doc_id) share one place in the order and divide the cut between them, as would rows
with equal keys;
an empty table gives an empty result; other columns of the input are ignored or, in ``mix_documents``, passed through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, write_table

#: Leading hex digits of the key that name a bucket.
DIGITS = 3


def mix_key(seed: str = "mix"):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def sizes(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, source, size and key of every row; the only step that reads texts."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), mix_key(seed).alias("key"))


def source_targets(sized: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size and target: one row per source.

    The share is filled by weight until a source reaches its cap; sorted by cap over weight, the level is the largest
    of (what is left) / (weights that are left), which is the end of resharing the excess again and again.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    n = len(weights)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % n + 1).cast("int")))
    per = per.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - (F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most"))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", left / rest)
    level = F.max("level").over(everything)
    return per.select("source", "source_size", F.least(F.col("most"), level * F.col("w")).alias("target"))


def source_cuts(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets with the whole epochs and the place of the cut: the key it falls on, the words taken there and their sum.

    Two steps: prefix sums over a source's buckets find the one that holds the cut, and prefix sums over the keys of that
    bucket find the key. Only the rows of such buckets, one for each source, are sorted.
    """
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", epochs)
    targets = targets.withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    some = sized.filter("size > 0").withColumn("bucket", F.substring("key", 1, DIGITS))
    buckets = some.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("offset", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    wanted = targets.select(F.col("source").alias("t_source"), "rest")
    held = buckets.join(wanted, F.col("source").eqNullSafe(F.col("t_source")))
    held = held.filter((F.col("offset") <= F.col("rest")) & (F.col("rest") < F.col("offset") + F.col("words")))
    held = write_table(held.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), "offset", "rest"), "cut-buckets", 0)
    places = some.join(held, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    places = places.groupBy("source", "key", "offset", "rest").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    places = places.withColumn("start", F.col("offset") + F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    hit = (F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("words"))
    places = places.filter(hit).select(F.col("source").alias("p_source"), F.col("key").alias("cut_key"), "start", F.col("words").alias("cut_size"))
    cuts = targets.join(places, F.col("source").eqNullSafe(F.col("p_source")), "left")
    return cuts.select("source", "source_size", "target", "epochs", "cut_key", (F.col("rest") - F.col("start")).alias("cut_words"), "cut_size")


def mix_sizes(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """For every document the words that the mix takes of it: doc_id, size, source_size, target, taken, source."""
    sized = write_table(sizes(docs, seed), "sizes")
    cuts = write_table(source_cuts(sized, source_targets(sized, weights, share, cap)), "cuts", 0)
    cuts = cuts.withColumnRenamed("source", "cut_source")
    part = F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(F.col("key") == F.col("cut_key"), F.expr("size * cut_words div cut_size")).otherwise(F.lit(0))
    joined = sized.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "source")


def mix_documents(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a document is repeated once per epoch, and left out where the cut
    leaves it out; the document that the cut falls on stays whole if at least half of its words are before it.

    Texts are not shuffled: whether a row is before the cut depends on its key and its source's cut alone.
    """
    sized = write_table(sizes(docs, seed), "sizes")
    cuts = write_table(source_cuts(sized, source_targets(sized, weights, share, cap)), "cuts", 0)
    names = {c: f"__mix_{c}" for c in cuts.columns}
    cuts = cuts.select(*[F.col(c).alias(a) for c, a in names.items()])
    key, cut = mix_key(seed), F.col("__mix_cut_key")
    last = F.when(key < cut, 1).when((key == cut) & (F.col("__mix_cut_words") * 2 >= F.col("__mix_cut_size")), 1).otherwise(0)
    joined = docs.join(cuts, F.col("source").eqNullSafe(F.col("__mix_source")))
    joined = joined.withColumn("__mix_copies", (F.col("__mix_epochs") + last).cast("int")).filter("__mix_copies > 0")
    return joined.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*docs.columns)


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS DOUBLE) AS w, source_size * 2.0::DOUBLE AS most FROM per),
levels AS (
  SELECT *, (CAST((SELECT sum(source_size) FROM per) AS DOUBLE) * 1.5::DOUBLE
            - (sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) - most))
            / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
targets AS (SELECT source, source_size, least(most, (SELECT max(level) FROM levels) * w) AS target FROM levels),
budgets AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS epochs FROM targets),
placed AS (
  SELECT doc_id, s.source, size, k, source_size, target, epochs, CAST(floor(target - epochs * source_size) AS BIGINT) AS rest,
         CAST(sum(size) OVER (PARTITION BY s.source ORDER BY k) AS BIGINT) AS until,
         CAST(sum(size) OVER (PARTITION BY s.source, k) AS BIGINT) AS here
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + CASE WHEN until <= rest THEN size WHEN until - here < rest AND here > 0 THEN size * (rest - until + here) // here ELSE 0 END AS BIGINT) AS taken,
       source
FROM placed
"""
