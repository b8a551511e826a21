"""Comment moderation and title checks as streams: the batch rules behind a keyed state."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pressroom.functions.text import TOXIC_KEYWORDS
from pressroom.operators.dedupe import TITLE_LIMIT
from pressroom.operators.moderation import moderate
from pressroom.streaming.state import first_of_key, first_seen, is_new

STREAMED_COMMENT = (
    "id BIGINT, article_id STRING, user_id BIGINT, parent_id BIGINT, content STRING, created_at TIMESTAMP"
)


def read_comment_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """New files of the day-partitioned comment folder."""
    reader = spark.readStream.schema(f"{STREAMED_COMMENT}, day DATE")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def moderate_stream(
    incoming: DataFrame,
    scores: DataFrame,
    sink: str,
    checkpoint: str,
    keywords: Sequence[str] = TOXIC_KEYWORDS,
    key: str = "id",
) -> StreamingQuery:
    """Decide each comment once and write it to the folder of its micro-batch, one sub-folder per decision.

    A comment that is delivered again, in the same or a later micro-batch, is dropped before it is decided
    (``state.first_seen``), so the sink holds one row of each. A batch that is run again after a failure
    overwrites its own folder. The folder also names the run, a hash of the checkpoint's path: a new
    checkpoint over an old sink counts its batches from zero again and must not overwrite earlier decisions,
    and it leaves out the comments that other runs have decided.
    """
    spark = incoming.sparkSession
    run = run_id(checkpoint)
    others = _other_runs(spark, sink, run)
    kind = incoming.schema[key].dataType.simpleString()
    fresh = first_seen(incoming, key, _column_of(spark, sink, others, key, kind) if others else None)

    def decide(batch: DataFrame, number: int) -> None:
        decided = moderate(batch, scores, keywords, key)
        decided.drop("probabilities").withColumn(
            "decision", F.coalesce(F.col("decision"), F.lit("none"))
        ).write.mode("overwrite").partitionBy("decision").parquet(f"{sink}/run={run}/batch={number}")

    return (
        fresh.writeStream.foreachBatch(decide)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_decisions(spark: SparkSession, sink: str) -> DataFrame:
    """One decision per comment, as they stand in the sink."""
    rows = spark.read.parquet(sink)
    return rows.drop("batch", "run").withColumn("decision", F.nullif(F.col("decision"), F.lit("none")))


def keep_new_titles(
    incoming: DataFrame, stored: DataFrame, sink: str, checkpoint: str, order: Sequence[str]
) -> StreamingQuery:
    """Write the rows whose title is neither stored nor in the sink; the first of a batch wins.

    Titles, cut as they are stored, are the keys of a state store that starts with those of ``stored`` and of
    earlier runs' sinks: nothing is late or forgotten, rows without a title stay, as in a batch, and a batch
    reads nothing that was written before. A batch that is run again overwrites its own folder.
    """
    spark = incoming.sparkSession
    run = run_id(checkpoint)
    cut = F.substring("title", 1, TITLE_LIMIT)
    # The state that a new checkpoint starts with; an older one has its own. This run's folders are no part of
    # it: its first batch may have failed after it had written, and then comes again.
    others = _other_runs(spark, sink, run) if is_new(spark, checkpoint) else []
    known = _column_of(spark, sink, others, "title", "string").select(cut.alias("_title"))
    if is_new(spark, checkpoint):
        known = known.unionByName(stored.select(cut.alias("_title")))
    fresh = first_of_key(incoming.withColumn("_title", cut), "_title", order, known).drop("_title")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/run={run}/batch={number}")

    return (
        fresh.writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def keep_new_titles_within(
    incoming: DataFrame, stored: DataFrame, sink: str, checkpoint: str, event_time: str, horizon: str
) -> StreamingQuery:
    """``keep_new_titles`` with a bounded state: a title is forgotten when the event time has moved on by
    ``horizon`` (``"30 days"``) from its first row; rows that are later than that are dropped.

    Of the rows of one title within the horizon one stays, whichever comes first. Stored titles are joined
    to each micro-batch. Rows without a title all stay; ``event_time`` must not be NULL.
    """
    cut = F.substring("title", 1, TITLE_LIMIT)
    known = stored.select(cut.alias("_title")).distinct()
    keyed = incoming.withColumn("_title", cut).withWatermark(event_time, horizon)
    firsts = keyed.filter("_title is not null").dropDuplicatesWithinWatermark(["_title"]).join(known, "_title", "left_anti")
    fresh = firsts.unionByName(keyed.filter("_title is null")).drop("_title")
    return write_stream_table(fresh.select(*incoming.columns), sink, checkpoint)


def run_id(checkpoint: str) -> str:
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:12]


def _column_of(spark: SparkSession, sink: str, paths: list[str], column: str, kind: str) -> DataFrame:
    """One column of what stands in these folders of the sink."""
    if not paths:
        return spark.createDataFrame([], f"{column} {kind}")
    return spark.read.schema(f"{column} {kind}").option("basePath", sink).parquet(*paths).select(column)


def _other_runs(spark: SparkSession, sink: str, run: str) -> list[str]:
    """Folders of other runs in the sink; found through the sink's file system."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{sink}/run=*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return [path for status in found if not (path := str(status.getPath())).endswith(f"/run={run}")]


def write_stream_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
