"""Sinks. All writes are distributed; none gathers rows in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col

FORMATS = ("csv", "parquet", "json")


def export(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> str:
    """SNK-01: csv, parquet or json records; an empty table or another format is an error."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    if df.isEmpty():
        raise ValueError("nothing to export")
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).format(fmt).save(path)
    return path


def export_feature_metadata(metadata: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """SNK-03"""
    metadata.write.mode(mode).json(path)
    return path


def export_collection(collection: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> str:
    """SNK-04: parquet keeps vectors exactly; json is for reading elsewhere."""
    if fmt not in ("parquet", "json"):
        raise ValueError("format must be parquet or json")
    collection.write.mode(mode).format(fmt).save(path)
    return path


def transcript_lines(df: DataFrame, conversation: str = "conv_id", stamp: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """SNK-05: `[stamp] Role: text`, one line a message: a line break inside the text is written as \\n."""
    flat = F.regexp_replace(col(text), r"\r\n|\r|\n", r"\\n")
    line = F.format_string("[%s] %s: %s", col(stamp).cast("string"), F.initcap(col(role)), flat)
    return df.select(col(conversation), col(stamp), line.alias("value"))


def export_transcripts(df: DataFrame, path: str, conversation: str = "conv_id", stamp: str = "turn", mode: str = "errorifexists", **names) -> str:
    """SNK-05: text files in conversation and time order; a long conversation may span several files."""
    lines = transcript_lines(df, conversation, stamp, **names)
    ordered = lines.repartitionByRange(col(conversation), col(stamp)).sortWithinPartitions(conversation, stamp)
    ordered.select("value").write.mode(mode).text(path)
    return path


def export_query_history(log: DataFrame, path: str, seconds: str = "seconds", mode: str = "errorifexists") -> str:
    """SNK-05: the log as json records under `history`, its totals as one record under `totals`."""
    from ..operators.retrieval import query_statistics

    log.write.mode(mode).json(f"{path}/history")
    query_statistics(log, seconds).withColumn("exported_at", F.current_timestamp()).write.mode(mode).json(f"{path}/totals")
    return path
