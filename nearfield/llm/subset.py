"""A varied subset of given size, by determinantal greedy selection over composable core-sets.

The kernel of two vectors is exp(-distance / width), cosine distance. Greedy selection takes, again and again, the vector
with the greatest variance left given those taken, which is what most increases the determinant; incremental Cholesky rows make a step
one matrix-vector product. Shards are hashes of ids, so the result doesn't depend on how the points are partitioned. Every shard gives a core-set of
the full size; core-sets are merged, a bounded number at a time, by the same selection until one is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions import kernels
from nearfield.llm.peaks import linked_groups
from nearfield.session import materialize

#: Members of the subset.
SIZE = 256
#: Distance at which similarity has fallen to 1/e.
WIDTH = 0.35
#: Rows of a shard, and core-sets merged in one task: bound the memory of a task.
SHARD_ROWS, FAN_IN = 16_000, 32
#: A row's weight is 1 + EMPHASIS * ln(rows of its group, over all points; see peaks.density_peaks).
EMPHASIS = 0.05
_RAW = "id long, data array<float>, weight double"


def weights(members: DataFrame) -> DataFrame:
    """id, weight of the points of groups of at least 2, from id and group_id of all points: it grows as the logarithm of the group's size. All others weigh 1.

    So large groups are represented beside the far more numerous loose points; a second member of a group has hardly any variance left, whatever its weight.
    """
    size = members.groupBy("group_id").agg(F.count("*").alias("size")).where("size > 1")
    return members.select("id", "group_id").join(size, "group_id").select("id", (1.0 + EMPHASIS * F.log("size")).alias("weight"))


def greedy(u: np.ndarray, ids: np.ndarray, weight: np.ndarray, size: int, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(positions in the order taken, gain of each): gain is the weighted variance left, the factor by which the determinant grows. Ties go to the smaller id.

    When only copies of taken vectors are left, the smallest ids fill the rest with gain 0.
    """
    order = np.argsort(ids, kind="stable")
    u, root = u[order], np.sqrt(weight[order]).astype(np.float32)
    n = len(u)
    k = min(size, n)
    left = root.astype(np.float64) ** 2
    rows = np.zeros((k, n), np.float32)
    taken, gains = np.zeros(k, np.int64), np.zeros(k)
    free = np.ones(n, bool)
    for t in range(k):
        j = int(np.where(free, left, -1.0).argmax())
        if left[j] < 1e-6:
            taken[t:] = np.nonzero(free)[0][: k - t]
            break
        taken[t], gains[t] = j, left[j]
        free[j] = False
        similar = root * root[j] * np.exp((u @ u[j] - 1.0) / width)
        rows[t] = (similar - rows[:t, j] @ rows[:t]) / np.float32(np.sqrt(left[j]))
        left -= rows[t].astype(np.float64) ** 2
    return order[taken], gains


def _select(ids: np.ndarray, x: np.ndarray, weight: np.ndarray, size: int, width: float):
    first = np.unique(ids, return_index=True)[1]
    ids, x, weight = ids[first], x[first], weight[first]
    u = kernels.unit(x.astype(np.float64)).astype(np.float32)
    at, gains = greedy(u, ids, weight, size, width)
    return ids[at], x[at], weight[at], gains


def varied_subset(points: DataFrame, dim: int, size: int = SIZE, width: float = WIDTH, members: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """id, rank, gain: size points that cover the variety of the data; rank from 1 in the order taken.

    points has id and data, all vectors usable (see points.current_usable), or v instead of data (see points.current_packed). Repeated ids are one point, rows with a null id take no part; copies of a taken vector come last, with
    gain 0, and only if nothing else is left. With size or fewer points all are returned; size <= 0 and an empty table give no rows. Extra
    columns don't matter. The same points give the same subset, however they are partitioned.
    members may give id and group_id of all points, or of those in groups of at least 2 (see peaks.linked_groups), if they are known or cheaper to find elsewhere, and n the number of points, about.
    """
    spark, ready = points.sparkSession, "v" in points.columns
    schema = "id long, rank int, gain double"
    if size <= 0:
        return spark.createDataFrame([], schema)
    shards = max(1, -(-(points.count() if n is None else n) // SHARD_ROWS))

    def table_of(ids, x, weight) -> pa.Table:
        data = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dim), pa.int32()), pa.array(x.astype(np.float32).ravel()))
        return pa.table({"id": pa.array(ids, pa.int64()), "data": data, "weight": pa.array(weight)})

    def core_set(t: pa.Table, heavy: pa.Table) -> pa.Table:
        ids = t["id"].to_numpy()
        x = kernels.unpack(t["v"].to_pylist(), dim, np.float32) if ready else kernels.matrix(t["data"], dim)
        order = np.argsort(heavy["id"].to_numpy(), kind="stable")
        known, value = heavy["id"].to_numpy()[order], heavy["weight"].to_numpy()[order]
        weight = np.ones(len(ids))
        if len(known):
            at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
            weight = np.where(known[at] == ids, value[at], 1.0)
        return table_of(*_select(ids, x, weight, size, width)[:3])

    def merge(t: pa.Table) -> pa.Table:
        return table_of(*_select(t["id"].to_numpy(), kernels.matrix(t["data"], dim), t["weight"].to_numpy(), size, width)[:3])

    def last(t: pa.Table) -> pa.Table:
        ids, _, _, gains = _select(t["id"].to_numpy(), kernels.matrix(t["data"], dim), t["weight"].to_numpy(), size, width)
        return pa.table({"id": pa.array(ids), "rank": pa.array(np.arange(1, len(ids) + 1, dtype=np.int32)), "gain": pa.array(gains)})

    def shard(df: DataFrame):
        return df.groupBy(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("s"))

    src = points.where("id is not null").select(F.col("id").cast("long").alias("id"), F.col("v") if ready else F.col("data").cast("array<float>").alias("data"))
    heavy = weights(linked_groups(points, dim, n=n) if members is None else members)
    core = materialize(shard(src).cogroup(shard(heavy)).applyInArrow(core_set, _RAW), "core0")
    left, rounds = core.count(), 0
    while left > FAN_IN * size:
        groups = -(-left // (FAN_IN * size))
        rounds += 1
        g = F.pmod(F.xxhash64(F.lit(rounds), "id"), F.lit(groups)).alias("g")
        core = materialize(core.groupBy(g).applyInArrow(merge, _RAW), f"core{rounds}")
        left = core.count()
        if groups == 1:
            break
    return core.groupBy(F.lit(0).alias("g")).applyInArrow(last, schema)


def represented(points: DataFrame, subset: DataFrame, dim: int) -> DataFrame:
    """id, member, distance: for every point its nearest member of the subset. The subset is of bounded size and is sent to all tasks."""
    chosen = points.join(F.broadcast(subset.select("id").distinct()), "id", "left_semi").select(F.col("id").cast("long").alias("id"), "data").toArrow()
    ids, u = chosen["id"].to_numpy(), kernels.unit(kernels.matrix(chosen["data"], dim, np.float64))
    sent = points.sparkSession.sparkContext.broadcast((ids, u))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, u = sent.value
        for b in batches:
            if b.num_rows and len(ids):
                s = kernels.unit(kernels.matrix(b.column(1), dim, np.float64)) @ u.T
                j = s.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids[j]), pa.array(1.0 - s[np.arange(len(j)), j])], ["id", "member", "distance"])

    return points.where("id is not null").select(F.col("id").cast("long").alias("id"), F.col("data").cast("array<float>").alias("data")).mapInArrow(run, "id long, member long, distance double")
