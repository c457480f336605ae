"""Change streams: events to changes, batches to the store, and what forces a rescan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from metasearch.operators import overlay
from metasearch.schema import CHANGE_SCHEMA
from metasearch.store import LockedError, Store

#: Event types in an event's ``mask`` (array of strings).
REMOVES, UPSERTS = ["DELETE", "MOVED_FROM"], ["CREATE", "MOVED_TO", "ATTRIB", "CLOSE_WRITE", "RENAME"]
MOVES = ["MOVED_FROM", "MOVED_TO"]


def has(mask: Column, types: list[str]) -> Column:
    return F.arrays_overlap(mask, F.array(*map(F.lit, types)))


def event_changes(events: DataFrame) -> DataFrame:
    """(seq, op, path, ...) from events (seq, mask, role, named boolean, present boolean, path, ...).

    The old side of a rename, and what was deleted or moved away, is removed. The new side, and what was created, moved in or written, is
    an upsert if it is there, else removed. An event without a name counts only if attributes or contents changed.
    """
    mask, role = F.col("mask"), F.col("role")
    remove = (role == "Old") | ((role == "Current") & has(mask, REMOVES))
    touched = (role == "New") | has(mask, UPSERTS)
    op = F.when(F.col("named") & remove, "Remove").when(F.col("named") & touched, F.when(F.col("present"), "Upsert").otherwise("Remove"))
    op = op.when(~F.col("named") & (role == "Object") & has(mask, ["ATTRIB", "CLOSE_WRITE"]) & F.col("present"), "Upsert")
    return events.withColumn("op", op).filter("op is not null").drop("mask", "role", "named", "present")


def rescan_reason(events: DataFrame, atomic_rename: bool = True) -> str | None:
    """Why a batch of events can't be applied, if it can't."""
    mask = F.col("mask")
    found = events.agg(
        F.coalesce(F.bool_or(has(mask, ["Q_OVERFLOW"])), F.lit(False)).alias("overflow"),
        F.coalesce(F.bool_or(has(mask, ["ONDIR"]) & has(mask, [*MOVES, "RENAME"])), F.lit(False)).alias("folder"),
        F.coalesce(F.bool_or(has(mask, MOVES)), F.lit(False)).alias("moved"),
    ).first()
    if found["overflow"]:
        return "the event queue overflowed"
    if found["folder"]:
        return "a directory was renamed"
    return "a move came without its other side" if found["moved"] and not atomic_rename else None


def batch_changes(events: DataFrame) -> DataFrame:
    """The last change of each path in a batch."""
    return overlay.fold(event_changes(events))


def follow(stream: DataFrame, store: Store, checkpoint: str, compact_bytes: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Apply a stream of changes (CHANGE_SCHEMA) to the store, each micro-batch once, whatever is replayed.

    ``seq`` carries the order; a micro-batch may have any size. A failed batch marks the catalog stale, and the query ends; one that another writer
    keeps out only ends the query, and is applied by the next run.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read once, looked at and then written
        try:
            if compact_bytes is not None and store.needs_compaction(compact_bytes):
                store.compact()
            store.apply(batch_id, overlay.validate_changes(batch, None))
            if compact_bytes is not None and store.needs_compaction(compact_bytes):
                store.compact()
        except LockedError:
            raise
        except Exception as error:
            store.mark_stale(str(error)[:500])
            raise
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def follow_events(stream: DataFrame, store: Store, checkpoint: str, atomic_rename: bool = True) -> StreamingQuery:
    """The same from raw events: a batch that can't be applied marks the catalog stale and ends the query."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            reason = rescan_reason(batch, atomic_rename)
            if reason:
                store.mark_stale(reason)
                raise RuntimeError(reason)
            store.apply(batch_id, overlay.validate_changes(batch_changes(batch), None))
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_changes(spark, path: str, files_per_batch: int = 1) -> DataFrame:  # noqa: ANN001
    """A stream of Parquet change files."""
    return spark.readStream.schema(CHANGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


#: A stream of events, as event_changes() takes them.
EVENT_DDL = "seq bigint, mask array<string>, role string, named boolean, present boolean, path string, size bigint, mtime bigint, mode bigint, kind string, fs string, native_id bigint, native_parent bigint, source bigint"


def read_events(spark, path: str, files_per_batch: int = 1) -> DataFrame:  # noqa: ANN001
    """A stream of Parquet event files."""
    return spark.readStream.schema(EVENT_DDL).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def progress(query: StreamingQuery) -> list[dict]:
    """Batches and rows so far."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"]} for p in query.recentProgress]
