"""Row and scalar rules over each micro-batch of a stream; results are appended with the batch's number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.base import Context, Rule, RuleError
from ..plans.planner import results


def validate_stream(stream: DataFrame, rules: list[Rule], out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Writes rule, total_count, failed_count, passed, batch to the Parquet folder `out`. Rules that join or group are refused."""
    if wrong := [r.name for r in rules if r.kind not in ("row", "scalar")]:
        raise RuleError(f"not for streams: {wrong}")

    def each(batch: DataFrame, number: int) -> None:
        found = results(batch, rules, Context(batch.sparkSession)).withColumn("batch", F.lit(number).cast("long"))
        found.coalesce(1).write.mode("overwrite").parquet(f"{out.rstrip('/')}/{number:012d}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_results(spark, out: str) -> DataFrame:
    return spark.read.parquet(f"{out.rstrip('/')}/*")
