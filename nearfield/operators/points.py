"""Operators on points: validation, latest row of a label, upsert, removal, id allocation, random points, layers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearfield.functions import kernels
from nearfield.functions.vectors import unusable_reason
from nearfield.session import materialize


def latest(points: DataFrame, key: str = "label", order: str = "seq") -> DataFrame:
    """One row per key: the one with the greatest order. Null keys form one key; of rows that tie, the greatest by the other columns in turn.

    One aggregate over whole rows, so repeated versions of a hot label are reduced before the shuffle.
    """
    rest = [c for c in points.columns if c not in (key, order)]
    got = points.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_row"))
    return got.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in points.columns])


def current_usable(points: DataFrame, dim: int = 64) -> DataFrame:
    """Current rows of points (greatest seq of a label) whose vector is usable: columns label, id, data.

    Unusable means null, wrong length, a null, NaN or infinite element, or all zero. An unusable current row
    hides older usable ones. Further columns are dropped. Rows that repeat are one row.
    """
    narrow = points.select("label", "id", "data", "seq")
    cur = narrow.groupBy("label").agg(F.max(F.struct("seq", "id", "data")).alias("_row"))
    cur = cur.select("label", F.col("_row.id").alias("id"), F.col("_row.data").alias("data"))
    return cur.where(unusable_reason(F.col("data"), dim).isNull())


#: Bits of the map of labels with several rows: bounds what is sent (4 MB). With more such labels than that, more rows than needed take the way over the shuffle.
LABEL_BITS = 1 << 25
_BITMAP = 1 << 15


def _bit(label: Column) -> Column:
    return F.pmod(F.xxhash64(label), F.lit(LABEL_BITS))


def repeated_labels(points: DataFrame) -> np.ndarray:
    """A map of LABEL_BITS bits, as bytes: set for every label that has several rows (and for labels that share its bit)."""
    several = points.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select(_bit(F.col("label")).alias("h"))
    maps = several.groupBy((F.col("h") / _BITMAP).cast("int").alias("b")).agg(F.bitmap_construct_agg(F.col("h") % _BITMAP).alias("m")).collect()  # at most LABEL_BITS / _BITMAP rows
    out = np.zeros(LABEL_BITS // 8, np.uint8)
    for r in maps:
        out[r["b"] * (_BITMAP // 8) :][: _BITMAP // 8] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out


def current_packed(points: DataFrame, dim: int = 64) -> DataFrame:
    """The points of current_usable as id and v: the vector as bytes (see kernels.pack), which halves what is shuffled where that loses nothing.

    Only rows whose label may have several rows are shuffled; a map of bounded size says which. All others are current where they lie.
    """
    sent = points.sparkSession.sparkContext.broadcast(repeated_labels(points))

    def pack(several: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = sent.value
            for b in batches:
                h = b.column(4).to_numpy(zero_copy_only=False)
                b = b.filter(pa.array(((bits[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1) == several))
                good, x = kernels.usable_rows(b.column(3), dim)
                v = np.full(b.num_rows, None, object)
                v[good] = kernels.pack(x)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(v.tolist(), pa.binary())], ["label", "id", "seq", "v"])

        return run

    rows = points.select("label", F.col("id").cast("long").alias("id"), F.col("seq").cast("long").alias("seq"), F.col("data").cast("array<float>").alias("data"), _bit(F.col("label")).alias("h"))
    schema = "label string, id long, seq long, v binary"
    latest_ = rows.mapInArrow(pack(True), schema).groupBy("label").agg(F.max(F.struct("seq", "id", "v")).alias("_row"))
    several = latest_.select(F.col("_row.id").alias("id"), F.col("_row.v").alias("v"))
    return rows.mapInArrow(pack(False), schema).select("id", "v").unionAll(several).where("v is not null")


def validate(points: DataFrame, dim: int, zero_ok: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with a column reason)."""
    tagged = points.withColumn("reason", unusable_reason(F.col("data"), dim, zero_ok))
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())


def upsert(points: DataFrame, changes: DataFrame, key: str = "label") -> DataFrame:
    """Points with changes put over them: a label in changes replaces the stored row, whatever its id was."""
    kept = points.join(changes.select(key).distinct(), key, "left_anti")
    return kept.unionByName(changes, allowMissingColumns=True)


def remove(points: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """Points without those whose key is in gone. Unknown, repeated and null keys do nothing."""
    return points.join(gone.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """df with a running number from 0 in the given order, without bringing all rows into one task.

    Rows are range-partitioned and written, as the ranges come from a sample and another run might draw them otherwise; they are counted
    per partition, and the counts (one per partition) become offsets.
    """
    spark = df.sparkSession
    ranged = materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranged")
    inside = W.partitionBy("_p").orderBy(*order)
    counts = ranged.groupBy("_p").count().collect()  # one row per partition
    start, offsets = 0, {}
    for r in sorted(counts, key=lambda r: r["_p"]):
        offsets[r["_p"]] = start
        start += r["count"]
    if not offsets:
        return df.withColumn(name, F.lit(0).cast("long"))
    table = spark.createDataFrame([(k, v) for k, v in offsets.items()], "_p int, _o long")
    return ranged.withColumn("_r", F.row_number().over(inside)).join(F.broadcast(table), "_p").withColumn(name, F.col("_r") + F.col("_o") - 1).drop("_p", "_r", "_o")


def allocate_ids(new: DataFrame, free: DataFrame, next_id: int, key: str = "label") -> DataFrame:
    """new with column id: freed ids in ascending order first, then next_id, next_id + 1 ... New rows go in order of key.

    free has a column id; repeated and null ids count once or not at all.
    """
    rows = numbered(new, [F.col(key)], "_n")
    slots = numbered(free.select("id").where("id is not null").distinct(), [F.col("id")], "_n")
    n_free = slots.count()
    joined = rows.join(slots.withColumnRenamed("id", "_free"), "_n", "left")
    return joined.withColumn("id", F.coalesce(F.col("_free").cast("long"), F.lit(next_id) + F.col("_n") - F.lit(n_free))).drop("_n", "_free")


def level(key: Column, seed: int = 31337, rate: float = 1 / math.log(16)) -> Column:
    """Layer of a point, floor(-ln(u) * rate), u in (0, 1] from the first 32 bits of the MD5 of seed and key, so it doesn't depend on the order of insertion."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")).cast("binary")), 1, 8)
    u = (F.conv(digest, 16, 10).cast("double") + 1.0) / float((1 << 32) + 1)
    return F.floor(-F.log(u) * rate).cast("int")


def random_points(spark: SparkSession, n: int, dim: int, seed: int = 1, normalize: bool = True, start_id: int | None = None) -> DataFrame:
    """n points with elements uniform in [0, 1): label (a number from start_id, or a digest), id, data. The same seed gives the same points."""
    element = lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.col("n"), i), F.lit(1 << 24)).cast("double") / float(1 << 24))
    raw = F.transform(F.sequence(F.lit(1), F.lit(dim)), element)
    df = spark.range(n).withColumnRenamed("id", "n").withColumn("v", raw)
    if normalize:
        df = df.withColumn("l", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).withColumn("v", F.transform("v", lambda x: x / F.col("l")))
    label = F.md5(F.concat_ws("-", F.lit(seed), F.col("n"))) if start_id is None else (F.col("n") + start_id).cast("string")
    return df.select(label.alias("label"), F.col("n").cast("int").alias("id"), F.col("v").cast("array<float>").alias("data"))
