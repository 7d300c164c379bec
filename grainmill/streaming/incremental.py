"""Incremental training on a stream: every micro-batch is one step on the parameter store. An extension; the batch jobs are complete without it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grainmill.operators import badrows
from grainmill.params.learning import LogisticLearner
from grainmill.params.store import ParamStore
from grainmill.sources.files import explode_samples, parse_id_lines


def train_on_stream(lines: DataFrame, learner: LogisticLearner, store: ParamStore, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Trains on a stream of id lines (column value). The state is the store's snapshots.

    The number of a batch is kept with the snapshot it made, so a batch replayed after a failure is skipped, by a new process
    too if its store has the same folder. A learner of one epoch and batch makes one snapshot a micro-batch; of others, a
    micro-batch that failed in between is repeated from its last snapshot.
    """

    def step(batch: DataFrame, number: int) -> None:
        if store.tag is not None and number <= int(store.tag):
            return
        samples = explode_samples(parse_id_lines(batch.select("value").withColumn("sample_id", F.monotonically_increasing_id())))
        if not samples.isEmpty():
            learner.fit(samples, store, tag=str(number))

    writer = lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def split_stream(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, failed) of a stream of raw lines (line_no, feed, line): the bad-row operator is a narrow map and runs on streams unchanged."""
    return badrows.loaded_lines(lines), badrows.failed_lines(lines)


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts per time window and key with a watermark: late rows within it are added, later ones dropped by the engine."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))
