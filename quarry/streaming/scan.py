"""Reviews of submissions as they arrive.

Scanning and chunking look at one row at a time, so on a stream they need no state and
append; merging and scoring are per submission, and run on each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quarry import schemas
from quarry.operators import rules, scoring


def submissions(spark: SparkSession, path: str, schema: str = schemas.SUBMISSIONS_RAW, kind: str = "parquet") -> DataFrame:
    """A stream of the submissions whose files arrive in a folder."""
    return spark.readStream.schema(schema).format(kind).load(path)


def findings(stream: DataFrame) -> DataFrame:
    """The findings of a stream of submissions, without state."""
    return rules.scan(stream)


def write_scores(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Security scores of each micro-batch, given to ``sink`` with the batch's number, by
    which a sink can tell a batch that it has already seen."""

    def scored(batch: DataFrame, number: int) -> None:
        sink(scoring.scan_security(batch)[0], number)

    return stream.writeStream.foreachBatch(scored).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


