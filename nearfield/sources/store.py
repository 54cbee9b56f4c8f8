"""Named, versioned indexes on any file system Spark can reach.

root/prefix/index_name=NAME/v=N-TAG/{points,nodes,removed,bad_points,meta.json} holds what version N wrote, TAG is of the writer, and the file _commits/N names
that folder. A commit is the creation of that file, which fails if it exists: of two writers of one version one succeeds, and the other has touched nothing
of it. A reader sees the version it began with. Points are written in slices of a bounded number of rows; of a graph only the
shards that changed are written, the others stay in the folders of the versions that wrote them.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.index import IndexParams, VectorIndex
from nearfield.operators.ann import NODES
from nearfield.session import materialize, release

SLICE_ROWS = 500_000
PARTS = ("points", "nodes", "removed", "bad_points")
NODE_COLUMNS = ("shard", "id", "label", "data", "out_edges", "in_edges")


class IndexStore:
    def __init__(self, spark: SparkSession, root: str, prefix: str = "default", read_only: bool = False):
        self.spark, self.root, self.read_only = spark, f"{root.rstrip('/')}/{prefix}", read_only
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, rest: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{rest}" if rest else self.root)

    def _home(self, name: str) -> str:
        if not name or "/" in name or name.startswith((".", "_")):
            raise ValueError(f"not a name for an index: {name!r}")
        return f"index_name={name}"

    def _read(self, rest: str) -> str | None:
        p = self._path(rest)
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, rest: str, text: str) -> None:
        p, new = self._path(rest), self._path(rest + ".new")
        stream = self._fs.create(new, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._fs.delete(p, False)
        if not self._fs.rename(new, p):
            raise OSError(f"can't rename to {rest}")

    def _writable(self) -> None:
        if self.read_only:
            raise PermissionError("the store was opened read-only")

    def names(self) -> list[str]:
        if not self._fs.exists(self._path("")):
            return []
        found = (s.getPath().getName() for s in self._fs.listStatus(self._path("")))
        return sorted(n.split("=", 1)[1] for n in found if n.startswith("index_name=") and self.version(n.split("=", 1)[1]) is not None)

    def _commits(self, name: str) -> dict[int, str]:
        home = self._path(f"{self._home(name)}/_commits")
        if not self._fs.exists(home):
            return {}
        found = (st.getPath().getName() for st in self._fs.listStatus(home))
        return {int(n): n for n in found if n.isdigit()}

    def version(self, name: str) -> int | None:
        return max(self._commits(name), default=None)

    def _folder(self, name: str, version: int) -> str | None:
        got = self._read(f"{self._home(name)}/_commits/{version}")
        return f"{self._home(name)}/{got}" if got else None

    def _meta(self, name: str, version: int | None) -> dict | None:
        folder = self._folder(name, version) if version is not None else None
        text = self._read(f"{folder}/meta.json") if folder else None
        return json.loads(text) if text else None

    def marks(self, name: str) -> dict:
        """What the writer of the current version left with it."""
        return (self._meta(name, self.version(name)) or {}).get("marks", {})

    def _commit(self, name: str, version: int, folder: str) -> None:
        path = self._path(f"{self._home(name)}/_commits/{version}")
        try:
            stream = self._fs.create(path, False)
        except Exception as e:
            raise RuntimeError(f"another writer has committed version {version} of {name}") from e
        try:
            stream.write(bytearray(folder.encode()))
        finally:
            stream.close()

    def _save_nodes(self, nodes: DataFrame, name: str, folder: str, old: dict | None) -> dict:
        """Write the shards whose rows differ from those of the old version; per shard its folder, number of rows and checksum."""
        held = materialize(nodes, "nodes")
        row = F.xxhash64(*[c for c in held.columns if c != "shard"]).cast("decimal(38,0)")
        sums = held.groupBy("shard").agg(F.count("*").alias("n"), F.sum(row).cast("string").alias("s")).collect()  # one row per shard
        before = (old or {}).get("shards", {})
        shards, dirty = {}, []
        for r in sums:
            was = before.get(str(r["shard"]))
            same = was is not None and was[1:] == [r["n"], r["s"]]
            shards[str(r["shard"])] = was if same else [folder, r["n"], r["s"]]
            dirty += [] if same else [r["shard"]]
        if dirty:
            some = held if len(dirty) == len(sums) else held.join(F.broadcast(self.spark.createDataFrame([(d,) for d in dirty], "shard int")), "shard", "left_semi")
            some.repartition(len(dirty), "shard").write.partitionBy("shard").parquet(f"{self.root}/{folder}/nodes")
        release(held)
        return shards

    def save(self, name: str, index: VectorIndex, slice_rows: int = SLICE_ROWS, expected: int | None = None, marks: dict | None = None) -> int:
        """Write a new version and make it current; its number. With expected, only if that is still the current version. marks are kept with the version."""
        self._writable()
        old = self.version(name)
        if expected is not None and expected != old:
            raise RuntimeError(f"version {old} is current, not {expected}")
        new = (old or 0) + 1
        part_of = f"v={new}-{uuid.uuid4().hex[:12]}"
        folder = f"{self._home(name)}/{part_of}"
        rows, has = {}, []
        for part in PARTS:
            df = getattr(index, part)
            if df is not None and part != "nodes":
                df.write.option("maxRecordsPerFile", slice_rows).parquet(f"{self.root}/{folder}/{part}")
                rows[part] = self.spark.read.parquet(f"{self.root}/{folder}/{part}").count()  # from the footers
                has.append(part)
        shards = self._save_nodes(index.nodes, name, folder, self._meta(name, old)) if index.nodes is not None else None
        if shards is not None:
            rows["nodes"] = sum(v[1] for v in shards.values())
        top = index.entry_point().first()
        meta = {"rows": rows, "dim": index.dim, "metric": index.metric if isinstance(index.metric, str) else None, "params": index.params.as_dict(), "parts": has, "entry_point": top["id"] if top else None, "graph_shards": index.shards, "marks": marks or {}}
        meta |= {} if shards is None else {"shards": shards, "written_shards": sum(v[0] == folder for v in shards.values())}
        self._write(f"{folder}/meta.json", json.dumps(meta))
        self._commit(name, new, part_of)
        return new

    def history(self, name: str) -> list[dict]:
        """Of every version that is still there: number, rows per part, shards of the graph it wrote, its entry point, and whether it is current."""
        current, out = self.version(name), []
        for v in sorted(self._commits(name)):
            if (meta := self._meta(name, v)) is not None:
                out.append({"version": v, "rows": meta["rows"], "written_shards": meta.get("written_shards", 0), "entry_point": meta["entry_point"], "current": v == current})
        return out

    def load(self, name: str, version: int | None = None, metric=None) -> VectorIndex | None:
        """The index, at its current or a given version; None if there is none. A metric that is a function has to be given again.

        A long load can be cancelled like any Spark job: give it a tag with spark.addTag and call spark.interruptTag.
        """
        v = version if version is not None else self.version(name)
        meta = self._meta(name, v)
        if meta is None:
            return None
        base = f"{self.root}/{self._folder(name, v)}"
        parts = {p: self.spark.read.parquet(f"{base}/{p}") for p in meta["parts"]}
        if "shards" in meta:
            by: dict[str, list[int]] = {}
            for shard, (folder, *_) in meta["shards"].items():
                by.setdefault(folder, []).append(int(shard))
            kept = [self.spark.read.schema(NODES).parquet(f"{self.root}/{folder}/nodes").where(F.col("shard").isin(some)).select(*NODE_COLUMNS) for folder, some in sorted(by.items())]
            parts["nodes"] = reduce(DataFrame.unionAll, kept) if kept else self.spark.createDataFrame([], NODES)
        return VectorIndex(dim=meta["dim"], metric=metric or meta["metric"] or "cosine", params=IndexParams(**meta["params"]), shards=meta["graph_shards"], **parts)

    def node_count(self, name: str) -> int:
        """Points of the current version, as counted when it was written; 0 if there is none."""
        meta = self._meta(name, self.version(name))
        return 0 if meta is None else meta["rows"]["points"]

    def drop(self, name: str) -> None:
        self._writable()
        self._fs.delete(self._path(self._home(name)), True)

    def vacuum(self, name: str) -> list[int]:
        """Forget versions before the current one; their numbers. Folders of which the current version still uses shards lose all else."""
        self._writable()
        current = self.version(name)
        meta = self._meta(name, current)
        if meta is None:
            return []
        used = {folder for folder, *_ in meta.get("shards", {}).values()}
        gone = sorted(v for v in self._commits(name) if v < current)
        for v in gone:
            folder = self._folder(name, v)
            for part in (*(p for p in PARTS if p != "nodes"), "meta.json") if folder in used else ("",):
                self._fs.delete(self._path(f"{folder}/{part}" if part else folder), True)
            self._fs.delete(self._path(f"{self._home(name)}/_commits/{v}"), False)
        return gone

    def get_config(self, key: str):
        text = self._read("_config.json")
        return json.loads(text).get(key) if text else None

    def save_config(self, key: str, value) -> None:
        self._writable()
        text = self._read("_config.json")
        self._write("_config.json", json.dumps((json.loads(text) if text else {}) | {key: value}))


def slices(points: DataFrame, slice_rows: int) -> DataFrame:
    """slice_no, n_rows if rows are cut in order of id: one slice if there are no more than slice_rows. (save cuts what each task writes, which needs no order.)"""
    from nearfield.operators.points import numbered

    rows = numbered(points.select("id"), [F.col("id")], "_n")
    return rows.groupBy((F.floor(F.col("_n") / slice_rows) + 1).alias("slice_no")).agg(F.count("*").alias("n_rows"))
