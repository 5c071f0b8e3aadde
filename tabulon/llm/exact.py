"""Exact duplicates by progressive refinement: length, then a hash of the beginning, then the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import few_parts, staged
from .common import key_filter, normalised, with_filter

PREFIX = 256


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: Column | None = None, prefix: int = PREFIX) -> DataFrame:
    """One row per document: id, `keep_id`, `group_size`, `kept` and, if given, `carry` as `carried`.

    Texts are equal when they are the same after each run of ASCII white space became one space; null is an empty text.
    Of equal texts the smallest id stays (null ids come last); among rows that also share the id, the first one in file
    order stays, so exactly one row of a group has `kept`. Other columns are ignored; an empty table gives no rows.

    The first scan keeps two numbers a row and counts them: a text whose length and beginning nobody shares is done. The
    second scan digests whole texts, but only of rows that a filter of fixed size lets through. What is grouped and
    joined is digests; counts of copies are combined before each shuffle.
    """
    rows, groups = _grouped(docs, id_column, text_column, carry, prefix)
    carried = ["_carried"] if carry is not None else []
    extra = [F.col("_carried").alias("carried")] if carried else []
    alone = rows.where("_full IS NULL").select(F.col("_id").alias(id_column), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *extra)
    joined = rows.where("_full IS NOT NULL").join(groups, "_full", "left")
    joined = joined.select(
        F.col("_id").alias(id_column), F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"), (F.col("_size").isNull() | (F.col("_row") == F.col("_keep_row"))).alias("kept"), *extra,
    )
    return alone.unionByName(joined)


def _grouped(docs: DataFrame, id_column: str, text_column: str, carry: Column | None, prefix: int) -> tuple[DataFrame, DataFrame]:
    """The staged rows, with the digest of those whose length and beginning are shared; and the digests of several rows."""
    norm = normalised(F.col(text_column))
    length, start = F.length(norm).cast("long"), F.xxhash64(F.substring(norm, 1, prefix))
    seen = docs.select(length.alias("_n"), start.alias("_start"))
    # Two rows that share length and beginning share the length, so one aggregate does both levels.
    shared = seen.groupBy("_n", "_start").agg(F.count("*").alias("_c")).where("_c > 1")
    marks = key_filter(shared, F.xxhash64("_n", "_start"))

    rows = docs.select(F.col(id_column).alias("_id"), norm.alias("_text"), *([carry.alias("_carried")] if carry is not None else []))
    rows = with_filter(rows, F.xxhash64(F.length("_text").cast("long"), F.xxhash64(F.substring("_text", 1, prefix))), marks, "_again")
    carried = ["_carried"] if carry is not None else []
    rows = staged(rows.select(F.monotonically_increasing_id().alias("_row"), "_id", F.when(F.col("_again"), F.sha2(F.col("_text").cast("binary"), 256)).alias("_full"), *carried), "exact-rows")

    first = F.min(F.struct(F.isnull("_id").alias("n"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    groups = rows.where("_full IS NOT NULL").groupBy("_full").agg(first.alias("_first"), F.count("*").alias("_size")).where("_size > 1")
    groups = staged(groups.select("_full", F.col("_first.id").alias("_keep"), F.col("_first.row").alias("_keep_row"), "_size"), "exact-groups", per_core=1)
    return rows, groups


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, without those that repeat an earlier text.

    What is joined is digests and row numbers. The rows to drop then pass a filter of fixed size over the staged rows; of
    what it lets through, the rows that stay are told by their numbers, so no text is shuffled while the filter has room.
    """
    rows, groups = _grouped(docs, id_column, text_column, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), PREFIX)
    gone = rows.where("_full IS NOT NULL").select("_full", "_row").join(groups, "_full").where("_row <> _keep_row").select("_row")
    gone = staged(gone, "exact-gone", per_core=1)
    marked = with_filter(rows.select("_row", "_carried"), F.xxhash64("_row"), key_filter(gone, F.xxhash64("_row")), "_hit")
    hits = marked.where("_hit")
    spared = staged(hits.select("_row").join(gone, "_row", "left_anti"), "exact-spared", per_core=1)
    return marked.where("NOT _hit").unionByName(few_parts(hits.join(spared, "_row", "left_semi").select(*marked.columns), 4)).select("_carried.*")
