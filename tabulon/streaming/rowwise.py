"""Row-level operators on streams. They are stateless expressions, so a streaming frame takes them unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col
from ..operators import conversation as V, ml as M


def classify_messages(messages: DataFrame, text: str = "text") -> DataFrame:
    """CNV-01 and CNV-02 on arriving messages."""
    return messages.select("*", V.intent(col(text)).alias("intent"), V.entities(col(text)).alias("entities"))


def score_rows(model: PipelineModel, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """ML-09 and ML-16 on arriving rows."""
    scored = M.score(model, rows)
    return M.with_risk_label(scored, threshold=threshold) if "probability" in scored.columns else scored


def to_parquet(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None):
    """Append a stream to parquet once over the data at hand; the checkpoint makes a restart continue, not repeat."""
    out = transform(stream) if transform else stream
    return (out.withColumn("_written_at", F.current_timestamp()).writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path))
