"""A stream of changes applied to a stored index, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearfield.operators.points import latest
from nearfield.sources.store import IndexStore


def apply_changes(store: IndexStore, name: str, changes: DataFrame, batch_id: int | None = None) -> int | None:
    """Apply changes (op 'put' or 'remove', label, data, seq, payload) to a stored index; its new version.

    Of several changes to a label in a batch the one with the greatest seq counts. A batch that was applied already (after a restart) does nothing: its number is committed with the version.
    """
    before, marks = store.version(name), store.marks(name)
    if batch_id is not None and batch_id <= marks.get("batch", -1):
        return before
    index = store.load(name, before)
    if index is None:
        raise ValueError(f"no index named {name!r}")
    last = latest(changes, "label", "seq")
    out = index.remove(last.where("op = 'remove'").select("label"))
    puts = last.where("op = 'put'").drop("op", "seq")
    out = out.add(puts)
    return store.save(name, out, expected=before, marks=marks if batch_id is None else marks | {"batch": batch_id})


def follow(store: IndexStore, name: str, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Apply a stream of changes as it comes, or with once all that is there."""

    def each(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            apply_changes(store, name, batch, batch_id)

    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (w.trigger(availableNow=True) if once else w).start()


def latest_stream(stream: DataFrame, time: str, delay: str, window: str) -> DataFrame:
    """Changes per window of event time with a watermark: window start, number of changes, labels touched (about)."""
    w = stream.withWatermark(time, delay).groupBy(F.window(time, window))
    return w.agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels")).select(F.col("window.start").alias("start"), "n", "labels")
