"""Rescans as a stream: each new source in a drop folder is reconciled once (ST4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.plans import ingest
from lectern.plans import snapshot as store
from lectern.sources.inpx import source_fingerprint


def watch(spark: SparkSession, drop_folder: str, archive_root: str, root: str, checkpoint: str, mode: str = "failfast", genres: dict[str, str] | None = None) -> StreamingQuery:
    """Starts a query over the sources (`*.inpx`) in drop_folder; call with availableNow to work off what is there.

    The snapshot's id is the source's fingerprint, so a source that was published already is not read again, and a batch
    that is repeated after a failure publishes the same snapshot.
    """
    sources = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.inpx").option("maxFilesPerTrigger", 1).schema("path string, modificationTime timestamp, length long, content binary").load(drop_folder)

    def reconcile(batch: DataFrame, _: int) -> None:
        for r in batch.select("path", "modificationTime").collect():  # one file a batch; its content isn't read here
            own = source_fingerprint(r.path).removeprefix("sha256:")
            if store.current(spark, root) != own:
                ingest.scan(spark, r.path, archive_root, root, own, F.lit(r.modificationTime), mode, genres)

    return sources.writeStream.foreachBatch(reconcile).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
