"""Structured Streaming: running word counts, event-time windows and sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from textloom.functions import text as T


def running_word_counts(lines: DataFrame, column: str = "value") -> DataFrame:
    """(word, n) of a stream of lines, in update mode."""
    return lines.select(F.explode(T.words(F.col(column))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def window_counts(events: DataFrame, time: str, key: str, value: str, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums per tumbling or sliding window and key; events later than the watermark are dropped by a stream."""
    w = F.window("_tx_t", size, slide) if slide else F.window("_tx_t", size)
    rows = events.withColumn("_tx_t", F.col(time).cast("timestamp")).withWatermark("_tx_t", late)
    return rows.groupBy(w.alias("_tx_w"), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total")).select(F.col("_tx_w.start").alias("beg"), key, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of a key that end after a gap."""
    rows = events.withColumn("_tx_t", F.col(time).cast("timestamp")).withWatermark("_tx_t", late)
    s = rows.groupBy(F.session_window("_tx_t", gap).alias("_tx_w"), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("_tx_w.start").alias("beg"), "n")


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there and gives the memory table; for tests and small results."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


class Progress(StreamingQueryListener):
    """Tells how many rows a stream has read, whenever another ``every`` rows are full: spark.streams.addListener(Progress(print))."""

    def __init__(self, tell: Callable[[int], None], every: int = 1000):
        self.tell, self.every, self.rows = tell, every, 0

    def onQueryStarted(self, event: object) -> None:
        pass

    def onQueryProgress(self, event: object) -> None:
        before, self.rows = self.rows, self.rows + event.progress.numInputRows
        if self.rows // self.every > before // self.every:
            self.tell(self.rows // self.every * self.every)

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: object) -> None:
        pass
