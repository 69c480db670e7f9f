"""Continuous increments over growing folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def resume(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, key: str, work: Callable[[DataFrame], DataFrame], good: Column, interval: str | None = None, form: str = "parquet") -> StreamingQuery:
    """Work off new files of a folder: accepted rows go to sink/accepted, others to sink/rejected.

    Rows whose key was accepted before are left out, and so are repeats within a
    batch. Each batch has folders of its own (column __batch), which a batch that
    is run again replaces, so it adds nothing. Without an interval it ends when all
    files are read.
    """

    def batch(df: DataFrame, n: int) -> None:
        try:
            done = df.sparkSession.read.parquet(f"{sink}/accepted").where(F.col("__batch") < n).select(key)
            df = df.join(done, key, "left_anti")
        except Exception as e:  # noqa: BLE001  the first batch finds no folder
            if "PATH_NOT_FOUND" not in str(e):
                raise
        out = work(df.dropDuplicates([key])).withColumn("__good", good).persist()
        for folder, rows in (("accepted", out.where("__good")), ("rejected", out.where("not coalesce(__good, false)"))):
            rows.drop("__good").write.mode("overwrite").parquet(f"{sink}/{folder}/__batch={n}")
        out.unpersist()

    stream = spark.readStream.schema(schema).format(form).load(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=interval) if interval else stream.trigger(availableNow=True)).start()


def distinct_within(events: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """An addition of ours: the first row of each key within a watermark, so that state stays bounded."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


class Progress(StreamingQueryListener):
    """Rows and batches of each query so far."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.rows[str(event.id)] = self.batches[str(event.id)] = 0

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        k = str(event.progress.id)
        self.rows[k] = self.rows.get(k, 0) + event.progress.numInputRows
        self.batches[k] = self.batches.get(k, 0) + 1

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass
