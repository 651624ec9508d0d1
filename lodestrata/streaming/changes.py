"""Change feed: notification lines or change rows as a stream, applied to a state table and to statistics.

A notification is ``op,id,start,end,xmin,ymin,xmax,ymax`` with empty fields for
what is unknown. The latest change of an id wins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

ACTIONS = {"INSERT": "CREATE", "UPDATE": "UPDATE", "DELETE": "DELETE", "CREATE": "CREATE"}


def parse_notifications(lines: DataFrame, value: str = "value") -> DataFrame:
    """action, feature_id, start, end, xmin, ymin, xmax, ymax from notification lines; malformed ones have a null action."""
    parts = F.split(F.col(value), ",")
    get = lambda i: F.when(F.try_element_at(parts, F.lit(i + 1)) != "", F.try_element_at(parts, F.lit(i + 1)))
    action = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    return lines.select(
        F.try_element_at(action, F.upper(F.trim(get(0)))).alias("action"), get(1).alias("feature_id"),
        F.try_to_timestamp(get(2)).alias("start"), F.try_to_timestamp(get(3)).alias("end"),
        *(get(4 + i).try_cast("double").alias(n) for i, n in enumerate(("xmin", "ymin", "xmax", "ymax"))),
    )


def read_changes(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of change rows from a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def latest(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The last change of each id (of equally late ones, the greatest row)."""
    rest = [c for c in changes.columns if c not in (key, order)]
    m = F.max(F.struct(order, *rest)).alias("m")
    return changes.groupBy(key).agg(m).select(key, f"m.{order}", *(f"m.{c}" for c in rest))


def apply_changes(state: DataFrame, changes: DataFrame, key: str, order: str, action: str = "action") -> DataFrame:
    """The state after the changes: created and updated rows replace, deleted ones go."""
    last = latest(changes, key, order)
    kept = state.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.filter(F.col(action) != "DELETE").select(*state.columns))


def subscribe(changes: DataFrame, listeners: list[Callable[[DataFrame, int], None]], checkpoint: str, available_now: bool = True):
    """Run every listener on each micro-batch, in order; a batch counts only when all have run."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for f in listeners:
                f(batch, number)
        finally:
            batch.unpersist()

    writer = changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def extent_changes(changes: DataFrame) -> DataFrame:
    """Box and interval that the changes touch: what statistics must be renewed for."""
    return changes.agg(F.count("*").alias("changes"), F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.min("start").alias("start"), F.max("end").alias("end"))


class StatisticsCache:
    """Counts and extents by feature type; a change of a type drops what is known of it, so the next reader computes it anew."""

    def __init__(self):
        self._known: dict[tuple[str, str], Row] = {}

    def get(self, type_: str, statistic: str, compute: Callable[[], DataFrame]) -> Row:
        """The statistic's one row; ``compute`` gives it where it is not known."""
        if (type_, statistic) not in self._known:
            self._known[type_, statistic] = compute().first()
        return self._known[type_, statistic]

    def invalidate(self, type_: str) -> None:
        for k in [k for k in self._known if k[0] == type_]:
            del self._known[k]

    def listener(self, type_: str) -> Callable[[DataFrame, int], None]:
        """For :func:`subscribe`: a batch with changes drops the type's statistics."""

        def on_batch(batch: DataFrame, _: int) -> None:
            if not batch.isEmpty():
                self.invalidate(type_)

        return on_batch


def numbered(changes: DataFrame, key: str, order: str) -> DataFrame:
    """Changes with their number within each id, for replay."""
    return changes.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy(order)))
