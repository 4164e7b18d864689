"""Analyses of projects as changes to their files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gatecrest.operators import matching
from gatecrest.plans.exposure import Analysis, analyse
from gatecrest.sources.files import _routed

SCHEMA = "project string, file string, source string, seq long"


def watch(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[Analysis, int], None]) -> StreamingQuery:
    """Reads change events (project, file, source, seq) from Parquet files as they appear and hands each batch's analysis to sink.

    Of several changes of a file in a batch the one of greatest seq counts. A null source is a deletion and isn't
    analysed. A batch may be repeated after a failure with the same number, so sinks overwrite by it.
    """

    def run(batch: DataFrame, number: int) -> None:
        last = matching.first_by(batch, ["project", "file"], F.col("seq").desc_nulls_last())
        sink(analyse(_routed(last.where("source is not null").select("project", "file", "source"))), number)

    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(run).start()
