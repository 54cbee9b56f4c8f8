"""python -m nearfield stress [--count N] [--dim D] [--store DIR] | load ROOT NAME"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from nearfield.index import VectorIndex
from nearfield.operators.points import random_points
from nearfield.sources.store import IndexStore


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="nearfield", description="Try an index out, or show a stored one.")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("stress", help="build an index of random points and query it with all of them")
    s.add_argument("--count", type=int, default=1000)
    s.add_argument("--dim", type=int, default=512)
    s.add_argument("--store", help="also save and load it in this folder")
    lo = sub.add_parser("load", help="show parameters and layers of a stored index")
    lo.add_argument("root")
    lo.add_argument("name")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("nearfield").getOrCreate()
    if a.command == "load":
        began = time.time()
        index = IndexStore(spark, a.root).load(a.name)
        if index is None:
            raise SystemExit(f"no index named {a.name}")
        print(f"{index.count()} points, {index.dim} dimensions, {index.metric}, {time.time() - began:.2f} s")
        for k, v in index.params.as_dict().items():
            print(f"{k}: {v}")
        index.info().orderBy("layer").show(truncate=False)
        return
    began = time.time()
    points = random_points(spark, a.count, a.dim, start_id=0)
    index = VectorIndex(points, a.dim).build()
    if a.store:
        store = IndexStore(spark, a.store)
        store.save("stress", index)
        index = store.load("stress")
    else:
        index.nodes.cache()
    print(f"built: {index.nodes.count()} nodes, {time.time() - began:.2f} s")
    began = time.time()
    hits = index.query_approximate(points, 1).where("id = query_id").count()
    print(f"queried: {hits} of {a.count} found themselves, {time.time() - began:.2f} s")


if __name__ == "__main__":
    main()
