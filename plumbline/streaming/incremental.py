"""A profile kept up to date by a stream.

Each micro-batch is profiled by itself and its state written under the batch's id, so that a batch which is run again
after a failure replaces its own state and counts once. The profile so far is the sum of the states.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from plumbline.plans import profile
from plumbline.plans.options import Options, Structured


def updater(folder: str, options: Options | Structured | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each batch's state below `folder`, which all nodes share."""

    def update(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = profile.of(batch, options).to_json()
        spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/batch={batch_id}")

    return update


def start(stream: DataFrame, folder: str, checkpoint: str, options: Options | Structured | None = None, available_now: bool = False) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(updater(folder, options)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current(spark: SparkSession, folder: str) -> profile.Profile:
    """The sum over all batches; states are small and one for each batch."""
    states = [r["value"] for r in spark.read.text(folder).orderBy("batch").collect()]
    return profile.merged([profile.Profile.from_json(s) for s in states])
