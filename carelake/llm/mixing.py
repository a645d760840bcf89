"""Mixing sources to target weights by capped water-filling.

Targets: the mix's size is shared among the sources by weight; a source whose
share exceeds ``max_epochs`` times its size is clamped there, and the excess is
shared again by weight among the others until no source is above its clamp.
In the order of clamp / weight this has a closed form: the clamped sources are
a prefix of that order, so one running sum over the sources table finds them.

Drawing: a source's target is a number of whole repetitions of all its
documents and a fractional one. The fractional repetition takes documents in a
seeded order (md5 of seed and id) until the words are reached; the one document
that crosses the boundary gives its first words only, so that a source's words
equal its rounded target however long its documents are.

Only the sources table is ordered in one place (one row for each source).
Documents are summed by (source, slice of the seeded order), and only the
slice in which a source's fraction ends is put in order. Documents meet the
plan by source and slice, so that a source with a third of all rows is no
large group anywhere.

Edge cases: a null or empty text has size 0 and is never taken; a null source
is a source of its own and comes last; a null id is a text like another
(the empty text). Rows of equal id share a place in the order; if the cut
falls on them, each gives the same share of its words. An empty table gives no
rows. Column names of the documents never meet the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelake.llm.common import WORD, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = "mix"
#: Hexadecimal digits of the seeded order that name a slice: 4,096 slices a source.
SLICE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_order(doc_id: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    whole = Window.partitionBy()
    # the fill level at which a source is clamped, and what is left for the sources after it
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sources.withColumn("weight", weight)
        .withColumn("clamp", F.lit(max_epochs) * F.col("source_size"))
        .withColumn("level", F.col("clamp") / F.col("weight"))
        .withColumn("budget", F.lit(share) * F.sum("source_size").over(whole))
        .withColumn("rest", F.col("budget") - F.coalesce(F.sum("clamp").over(by_level), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_level), F.lit(0.0)))
        .withColumn("clamped", F.col("level") * F.col("weight_left") <= F.col("rest"))
    )
    # the fill level of the others: of the first source that isn't clamped
    water = F.min(F.when(~F.col("clamped"), F.struct("level", (F.col("rest") / F.col("weight_left")).alias("water")))).over(whole)["water"]
    return ranked.withColumn("water", water).select(
        "source", "source_size",
        F.when(F.col("clamped"), F.col("clamp")).otherwise(F.col("weight") * F.col("water")).alias("target"),
    )


def _placed(docs: DataFrame, seed: str) -> DataFrame:
    order = seeded_order(F.col("doc_id"), seed)
    return docs.withColumn("o", order).withColumn("slice", F.substring("o", 1, SLICE_DIGITS))


def draw_plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """What each (source, slice) of ``sized`` (doc_id, source, size) takes.

    Columns source, slice, source_size, target, whole (repetitions of all documents) and, for the fractional
    one, cut: a document takes part if its order is below ``cut_order``, and at it with the share
    ``cut_words`` / ``cut_size`` of its words."""
    docs = _placed(sized, seed)
    slices = docs.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    aims = targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, share, max_epochs)
    aims = aims.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn(
        "extra", F.round("target").cast("long") - F.col("whole") * F.col("source_size")
    )
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(
        slices.withColumn("start", F.coalesce(F.sum("slice_size").over(before), F.lit(0))).alias("s")
        .join(aims.alias("a"), F.col("s.source").eqNullSafe(F.col("a.source")))
        .select("s.source", "slice", "start", "slice_size", "source_size", "target", "whole", "extra"),
        "mixing-slices",
    )
    # the slice in which the fractional repetition ends; only its documents are put in order
    last = starts.where((F.col("start") <= F.col("extra")) & (F.col("extra") < F.col("start") + F.col("slice_size")))
    ahead = Window.partitionBy("source").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        docs.alias("d").join(last.alias("l"), F.col("d.source").eqNullSafe(F.col("l.source")) & (F.col("d.slice") == F.col("l.slice")))
        .groupBy("d.source", "o", "start", "extra").agg(F.sum("size").alias("cut_size"))
        .withColumn("cut_words", F.col("extra") - F.col("start") - F.coalesce(F.sum("cut_size").over(ahead), F.lit(0)))
        .where((F.col("cut_words") >= 0) & (F.col("cut_words") < F.col("cut_size")))
        .select("source", F.col("o").alias("cut_order"), "cut_words", "cut_size")
    )
    return starts.alias("s").join(cuts.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")), "left").select(
        "s.source", "slice", "source_size", "target", "whole",
        # a source that takes no fraction, or all of it, has no cut: nothing is below the empty order, all below "g"
        F.coalesce("cut_order", F.when(F.col("extra") >= F.col("source_size"), F.lit("g")).otherwise("")).alias("cut_order"),
        F.coalesce("cut_words", F.lit(0)).alias("cut_words"), F.coalesce("cut_size", F.lit(1)).alias("cut_size"),
    )


def _drawn(placed: DataFrame, plan: DataFrame) -> DataFrame:
    return placed.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.slice") == F.col("p.slice")))


def _cut(size: Column) -> Column:
    """Words of the fractional repetition at the cut."""
    return F.floor(F.col("cut_words") * size / F.col("cut_size")).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and taken for each row of ``docs`` (doc_id, source, text)."""
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mixing-sizes")
    part = F.when(F.col("o") < F.col("cut_order"), F.col("size")).when(F.col("o") == F.col("cut_order"), _cut(F.col("size"))).otherwise(0)
    return _drawn(_placed(sized, seed), draw_plan(sized, weights, share, max_epochs, seed)).select(
        "doc_id", "d.source", "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as they are taken, all columns kept and every text whole.

    Documents are drawn in the seeded order of id and text, so that rows of equal id, or without one, each have
    a place of their own; rows equal in both share one and fare alike. The document at a source's cut is taken
    where at least half of its words are within the target: a source's words come within half a document of it."""
    columns = docs.columns
    # by one struct, so that the documents' names meet none of ours
    whole = docs.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.md5("text")).alias("doc_id"), "source", word_count(F.col("text")).alias("size"), F.struct(*columns).alias("row"))
    sized = stored(whole.select("doc_id", "source", "size"), "mixing-sizes")
    drawn = _drawn(_placed(whole.select("doc_id", "source", "size", "row"), seed), draw_plan(sized, weights, share, max_epochs, seed))
    more = (F.col("o") < F.col("cut_order")) | ((F.col("o") == F.col("cut_order")) & (2 * F.col("cut_words") >= F.col("cut_size")))
    times = (F.col("whole") + more.cast("long")).cast("int")
    # a document without words is in no target: it is never taken
    copies = drawn.where(F.col("size") > 0).select("row", F.explode(F.array_repeat(F.lit(1), times)).alias("copy"))
    return copies.select(*[F.col("row")[c].alias(c) for c in columns])


#: DuckDB's form of the query's result.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
src AS (SELECT source, CAST(sum(size) AS DOUBLE) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM sized GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, sum(s) OVER () * 1.5 AS budget FROM src),
lv AS (SELECT *, 2 * s AS clamp, 2 * s / w AS level FROM w),
fill AS (SELECT *, budget - coalesce(sum(clamp) OVER r, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER r, 0) AS left_w FROM lv
  WINDOW r AS (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cl AS (SELECT *, level * left_w <= rest AS clamped FROM fill),
water AS (SELECT arg_min(rest / left_w, level) AS water FROM cl WHERE NOT clamped),
aim AS (SELECT source, CAST(s AS BIGINT) AS source_size, CASE WHEN clamped THEN clamp ELSE w * (SELECT water FROM water) END AS target FROM cl),
cut AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM aim),
place AS (SELECT d.*, c.source_size, c.target, c.whole, CAST(round(c.target) AS BIGINT) - c.whole * c.source_size AS extra
  FROM sized d JOIN cut c ON d.source IS NOT DISTINCT FROM c.source),
ties AS (SELECT source, o, sum(size) AS tie, coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sized GROUP BY source, o)
SELECT doc_id, size, source_size, target, CAST(whole * size + CASE
    WHEN ahead + tie <= extra THEN size
    WHEN ahead < extra THEN floor(CAST(extra - ahead AS DOUBLE) * size / tie)
    ELSE 0 END AS BIGINT) AS taken
FROM place p JOIN ties t ON p.source IS NOT DISTINCT FROM t.source AND p.o = t.o
"""
