"""Mix sources to target weights: whole copies that are certain, then a Pareto order sample of fixed size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.sizes import broadcast_if_small
from ..session import few_parts, staged
from .common import word_count

# Slices of the rank per level of the search for the border; two levels, so one slice in 2^24 is sorted.
SLICES = 4096


def source_targets(sizes: DataFrame, weights: Sequence[int], limit: int) -> DataFrame:
    """`_source`, `_source_size` → also `_weight` and `_target`; one row per source.

    Weights repeat along the sources in code point order, null last. A source stops at `limit` times its size and the
    rest goes to the others by weight: with sources in the order in which they reach their limit, the level of the
    common share is the largest of (words left) / (weight left).
    """
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    t = sizes.withColumn("_weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    t = t.withColumn("_cap", F.col("_source_size") * limit)
    before = Window.orderBy((F.col("_cap") / F.col("_weight")).asc(), F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    t = t.withColumn("_left", F.sum("_source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
    t = t.withColumn("_wleft", F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0)))
    level = F.max(F.col("_left").cast("double") / F.col("_wleft")).over(whole)
    return t.withColumn("_level", level).select(*sizes.columns, F.least(F.col("_cap").cast("double"), F.col("_weight") * F.col("_level")).alias("_target"))


def _rounded(measure: Column) -> Column:
    m = F.greatest(F.coalesce(F.nanvl(measure, F.lit(None)), F.lit(0.0)), F.lit(0.0))
    unit = F.pow(F.lit(2.0), F.floor(F.log2(m)) - 11)
    checked = F.when(m == float("inf"), F.raise_error(F.lit("a measure is infinite"))).otherwise(F.rint(m / unit) * unit)
    return F.when(m > 0, checked.cast("double")).otherwise(0.0)


def copy_levels(classes: DataFrame, targets: DataFrame, limit: int) -> DataFrame:
    """`_source`, `_level`: documents of measure m have least(limit, m × `_level`) expected copies, which adds up to the target.

    `classes` holds the words per source and measure (`_m`, `_words`). The largest measures reach the limit first; with k
    of them there, the level is (target − limit × their words) / (the others' words, each times its measure), and the
    largest of these over k is the one that holds, as for the sources. A source without a measured word has level 0.
    """
    down = Window.partitionBy("_source").orderBy(F.col("_m").desc())
    at = classes.withColumn("_above", F.coalesce(F.sum("_words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = at.withColumn("_rest", F.sum(F.col("_m") * F.col("_words")).over(down.rowsBetween(0, Window.unboundedFollowing)))
    at = at.join(targets.select(F.col("_source").alias("_s"), "_target"), F.col("_source").eqNullSafe(F.col("_s")))
    level = F.max(F.when(F.col("_rest") > 0, (F.col("_target") - F.col("_above") * limit) / F.col("_rest")))
    return at.groupBy("_source").agg(F.coalesce(level, F.lit(0.0)).alias("_level"))


def digits(text: Column) -> Column:
    """A measure for `mix`: the binary digits of a text's number of words, so that longer documents are repeated more often."""
    return F.length(F.bin(word_count(text))).cast("double")


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: Sequence[int] = (5, 2, 1),
        limit: int = 3, seed: int = 17, measure: Column | None = None, carry: Column | None = None) -> DataFrame:
    """One row per document: id, `source`, `size` (words), `source_size`, `target`, `copies`, `taken` (size × copies), `carried`.

    Each document has an expected number of copies, in proportion to its `measure` (1 for all, if none is given; null and
    negative count as 0) and at most `limit`; within a source they add up to the target. The whole part is certain. The
    fraction p is an inclusion probability: documents are ranked by u/(1−u) over p/(1−p), u a keyed hash of the id, and
    taken from the front until the source's words are nearest its target. Reruns agree; the words of a source miss its
    target by half a document at most (by more only where documents of measure 0, which are never taken, are needed).
    Measures are rounded to 12 binary digits, so that a source has few of them; infinite ones are an error. Null text has
    size 0, null source is a source of its own, rows that share an id are ranked by size; a source without words has
    target 0; an empty table gives no rows.

    A source may hold most rows: no window sees a source whole. The border of each source is found by adding up words
    per slice of the rank, twice, and only the slice that holds the border is sorted.
    """
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    kept = [carry.alias("carried")] if carry is not None else []
    rows = docs.select(F.col(id_column).alias("_id"), F.col(source_column).alias("_source"), word_count(F.col(text_column)).alias("_size"), u.alias("_u"),
                       (F.lit(1.0) if measure is None else _rounded(measure.cast("double"))).alias("_m"), *kept)
    rows = staged(rows, "mix-rows")
    classes = staged(rows.groupBy("_source", "_m").agg(F.sum("_size").alias("_words")), "mix-classes", per_core=1)
    sizes = staged(source_targets(classes.groupBy("_source").agg(F.sum("_words").alias("_source_size")), weights, limit), "mix-sources", per_core=1)
    levels = staged(copy_levels(classes, sizes, limit), "mix-levels", per_core=1)

    def per_source(left: DataFrame, right: DataFrame) -> DataFrame:
        right = broadcast_if_small(right.withColumnRenamed("_source", "_s"))
        return left.join(right, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")

    rows = per_source(per_source(rows, sizes), levels).withColumn("_e", F.least(F.lit(float(limit)), F.col("_m") * F.col("_level")))
    rows = rows.withColumn("_whole", F.floor("_e"))
    rows = rows.withColumn("_p", F.col("_e") - F.col("_whole"))
    odds = (F.col("_u") / (1.0 - F.col("_u"))) / (F.col("_p") / (1.0 - F.col("_p")))
    rows = rows.withColumn("_q", F.when(F.col("_p") > 0, odds)).withColumn("_v", F.col("_q") / (1.0 + F.col("_q")))
    place = F.col("_v") * float(SLICES)
    rows = rows.withColumn("_d1", F.least(F.floor(place), F.lit(SLICES - 1)).cast("int"))
    rows = rows.withColumn("_d2", F.least(F.floor((place - F.col("_d1")) * float(SLICES)), F.lit(SLICES - 1)).cast("int"))

    certain = rows.groupBy("_source").agg(F.sum(F.col("_whole") * F.col("_size")).alias("_certain"))
    quota = sizes.select("_source", "_target").join(certain.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left")
    quota = staged(quota.select("_source", (F.col("_target") - F.col("_certain")).alias("_quota"), F.lit(0).cast("long").alias("_from")), "mix-quota", per_core=1)

    def border(among: DataFrame, at: DataFrame, digit: str, label: str) -> DataFrame:
        """The slice of each source in which its words reach the quota, and the words before that slice."""
        sums = per_source(among.groupBy("_source", digit).agg(F.sum("_size").alias("_sum")), at)
        upto = F.sum("_sum").over(Window.partitionBy("_source").orderBy(digit).rowsBetween(Window.unboundedPreceding, 0))
        sums = sums.withColumn("_end", F.col("_from") + upto).withColumn("_begin", F.col("_end") - F.col("_sum"))
        return staged(sums.where("_begin < _quota AND _quota <= _end").select("_source", "_quota", F.col("_begin").alias("_from"), F.col(digit).alias(f"_b{digit[2:]}")), label, per_core=1)

    drawn = rows.where("_p > 0")
    b1 = border(drawn, quota, "_d1", "mix-border1")
    inside = per_source(drawn, b1).where("_d1 = _b1").drop("_quota", "_from")
    b2 = border(inside, b1.select("_source", "_quota", "_from"), "_d2", "mix-border2").select("_source", "_b2", F.col("_from").alias("_before"))
    total = drawn.groupBy("_source").agg(F.sum("_size").alias("_all"))
    cut = per_source(per_source(per_source(quota.select("_source", "_quota"), total), b1.select("_source", "_b1")), b2)
    # Where all fractions together don't reach the quota (it needs documents of measure 0), every fraction is taken.
    short = (F.col("_quota") > 0) & (F.col("_all") < F.col("_quota"))
    cut = staged(cut.select("_source", "_quota", F.when(short, SLICES).otherwise(F.col("_b1")).alias("_b1"), "_b2", "_before"), "mix-cut", per_core=1)

    rows = per_source(rows, cut)
    edge = F.coalesce((F.col("_d1") == F.col("_b1")) & (F.col("_d2") == F.col("_b2")), F.lit(False))
    ahead = (F.col("_d1") < F.col("_b1")) | ((F.col("_d1") == F.col("_b1")) & (F.col("_d2") < F.col("_b2")))
    clear, close = rows.where(~edge).withColumn("_take", F.coalesce(ahead, F.lit(False))), rows.where(edge)
    running = F.sum("_size").over(Window.partitionBy("_source").orderBy("_v", "_id", "_size").rowsBetween(Window.unboundedPreceding, 0))
    close = close.withColumn("_take", F.col("_before") + running - F.col("_size") / 2.0 <= F.col("_quota"))
    out = clear.unionByName(few_parts(close, 4))
    copies = (F.col("_whole") + F.col("_take").cast("long")).cast("long")
    return out.select(F.col("_id").alias(id_column), F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                      F.col("_target").alias("target"), copies.alias("copies"), (copies * F.col("_size")).alias("taken"), *(["carried"] if kept else []))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it."""
    out = mix(docs, carry=F.struct(*[F.col(f"`{c}`") for c in docs.columns]), **options)
    return out.where("copies > 0").select(F.explode(F.expr("array_repeat(carried, cast(copies as int))")).alias("carried")).select("carried.*")
