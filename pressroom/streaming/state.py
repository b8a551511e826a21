"""The first row of every key of a stream, kept in a state store."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pressroom.session import ship

STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_KEY = "_key"


class _FirstRow(StatefulProcessor):
    """State of a key: a mark that it was seen."""

    def __init__(self, order: Sequence[str]):
        self.order = list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def _place(self, row: Row) -> tuple:
        return tuple((row[name] is not None, row[name]) for name in self.order)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        first = min(rows, key=self._place, default=None)
        if first is not None and not self.seen.exists():
            self.seen.update((True,))
            yield first

    def handleInitialState(self, key, initial_state, timer_values) -> None:
        self.seen.update((True,))

    def close(self) -> None:
        pass


def first_of_key(stream: DataFrame, key: str, order: Sequence[str], seen: DataFrame) -> DataFrame:
    """Rows of the first micro-batch that holds their key, one for each: the first in ``order``, NULLs first.

    ``seen`` (one column) are keys that count as seen when the checkpoint is new. Nothing is forgotten and
    nothing is late; a micro-batch costs look-ups for its own keys, however many there were before. Rows
    without a key all stay. Before the shuffle every Arrow batch is thinned to one row of a key, so a key that
    fills a micro-batch is not gathered by one task.
    """
    spark = stream.sparkSession
    ship(spark)
    spark.conf.set(STORE_SETTING, STORE)
    order = list(order)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select([key, *order]).to_pandas()
            rows.columns = range(len(rows.columns))
            by = list(range(1, len(rows.columns)))
            firsts = rows.sort_values(by, kind="stable", na_position="first") if by else rows
            yield batch.take(pa.array(firsts.drop_duplicates([0]).index.sort_values()))

    thinned = stream.filter(F.col(key).isNotNull()).mapInArrow(thin, stream.schema)
    known = seen.select(F.col(seen.columns[0]).alias(_KEY)).filter(F.col(_KEY).isNotNull()).distinct()
    keyed = thinned.withColumn(_KEY, F.col(key))
    firsts = keyed.groupBy(_KEY).transformWithState(
        _FirstRow(order), keyed.schema, "append", "none", initialState=known.groupBy(_KEY)
    )
    return firsts.drop(_KEY).unionByName(stream.filter(F.col(key).isNull()))


def first_seen(stream: DataFrame, key: str, seen: DataFrame | None = None) -> DataFrame:
    """One row of each key, of the first micro-batch that holds it, where all rows of a key say the same.

    The state is Spark's own and stays in the JVM; nothing is forgotten. Keys in ``seen`` (one column) are left
    out of every micro-batch. Rows without a key all stay.
    """
    stream.sparkSession.conf.set(STORE_SETTING, STORE)
    firsts = stream.filter(F.col(key).isNotNull()).dropDuplicates([key])
    if seen is not None:
        firsts = firsts.join(seen.toDF(key).distinct(), key, "left_anti").select(*stream.columns)
    return firsts.unionByName(stream.filter(F.col(key).isNull()))


def is_new(spark: SparkSession, checkpoint: str) -> bool:
    """True if no micro-batch of this checkpoint has been committed."""
    first = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/0")
    return not first.getFileSystem(spark._jsc.hadoopConfiguration()).exists(first)
