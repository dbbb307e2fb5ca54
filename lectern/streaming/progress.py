"""The newest progress of each job, kept as a stream of events comes in (ST7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.reconcile import latest_per_job
from lectern.plans import snapshot as store

TABLE = "progress"


def newer(state: DataFrame | None, batch: DataFrame, job: str, order: list[str]) -> DataFrame:
    """The last row of each job of a batch, where the state has none that is as late or later."""
    last = latest_per_job(batch, job, order).select(batch.columns)
    if state is None:
        return last
    known = state.select(job, F.struct(*order).alias("_known"))
    return last.join(known, job, "left").filter(F.col("_known").isNull() | (F.struct(*order) > F.col("_known"))).drop("_known")


def follow(spark: SparkSession, events: DataFrame, root: str, checkpoint: str, job: str, order: list[str]) -> StreamingQuery:
    """Starts a query that keeps the last event of each job, by `order`, as the table `progress` of a versioned store.

    Late and repeated events change nothing, so a batch that is repeated after a failure does no harm. A batch writes the
    jobs that it moved on; the state is a table, not memory of the query, and grows with the jobs alone. Call with
    availableNow to work off what is there.
    """

    def merge(batch: DataFrame, number: int) -> None:
        draft = store.Draft(spark, root, f"batch-{number}")
        rows = newer(draft.old(TABLE), batch, job, order)
        draft.change(TABLE, job, rows)
        if draft.base and draft.tables == draft.base.tables:
            draft.drop()
        else:
            draft.commit()

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, root: str) -> DataFrame:
    """The last event of each job."""
    return store.table(spark, root, TABLE)
