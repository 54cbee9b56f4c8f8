"""Filling containers of a fixed number of tokens with whole texts.

Texts are measured once with a public tokenizer. A text longer than a container is cut into full pieces and a rest; all
others stay whole. Items are spread over shards of a bounded number of items, and each shard is packed by bin completion:
branch and bound over the undominated fillings around the largest item left, best-fit decreasing as first incumbent, and
the waste bound to prune. The emptiest containers of a shard give their items back, a bounded number; these meet in ever
fewer shards until one is left, so unused space doesn't grow with the number of shards.
"""

from __future__ import annotations

import base64
import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.session import materialize

#: Tokens of a container.
CAPACITY = 2048
#: Items of a shard, about: bounds the memory and time of a task.
SHARD_ITEMS = 8_000
#: Shards whose leftovers meet in one shard of the next round.
FAN_IN = 16
#: Fillings tried per container (None: all undominated ones), and nodes of the search tree per shard. When they are used up, the best complete solution stands.
WIDTH, NODES = 4, 40_000


@functools.cache
def encoder(path: str):
    """The tokenizer of a .tiktoken file of ranks; special tokens in a text are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def count_tokens(documents: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, tokens of every row of documents; 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, tokens long")


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers as lists of positions in sizes."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), ascending
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        at = bisect.bisect_left(rooms, (s, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room > s:
            bisect.insort(rooms, (room - s, b))
    return bins


class _Stock:
    """Items left, as a count per size, with the sizes present in ascending order."""

    def __init__(self, sizes: np.ndarray):
        values, counts = np.unique(sizes, return_counts=True)
        self.count = dict(zip(values.tolist(), counts.tolist()))
        self.sizes = values.tolist()
        self.total = int(sizes.sum())

    def take(self, s: int) -> None:
        self.total -= s
        self.count[s] -= 1
        if not self.count[s]:
            del self.sizes[bisect.bisect_left(self.sizes, s)]

    def put(self, s: int) -> None:
        self.total += s
        if not self.count[s]:
            bisect.insort(self.sizes, s)
        self.count[s] += 1

    def largest_at_most(self, room: int) -> int:
        i = bisect.bisect_right(self.sizes, room)
        return self.sizes[i - 1] if i else 0


def _dominated(filling: tuple[int, ...], room: int, stock: _Stock) -> bool:
    """Whether an item left could stand for one or two of the filling and leave less room: then the filling needn't be tried."""
    slack = room - sum(filling)
    used = set(filling)
    for i, a in enumerate(filling):
        if slack and (y := stock.largest_at_most(a + slack)) > a and y not in used:
            return True
        for b in filling[i + 1 :]:
            if (y := stock.largest_at_most(a + b + slack)) >= a + b and y not in used:
                return True
    return False


def fillings(stock: _Stock, room: int, width: int | None) -> list[tuple[int, ...]]:
    """Undominated fillings of room, fullest first: all with width None, else up to width of those met on the way along the width largest sizes that fit,
    in at most 60 width steps. A filling without waste ends the search: none is better."""
    found: dict[tuple[int, ...], int] = {}
    steps = 0

    def extend(chosen: tuple[int, ...], left: int, cap: int) -> bool:
        nonlocal steps
        s = stock.largest_at_most(min(left, cap))
        if not s or not left:
            found[chosen] = left
            return not left
        i = bisect.bisect_right(stock.sizes, s) - 1
        tries = 0
        while i >= 0 and (width is None or (tries < width and steps < 60 * width)):
            s = stock.sizes[i]
            if stock.count[s] > chosen.count(s):
                steps, tries = steps + 1, tries + 1
                if extend((*chosen, s), left - s, s):
                    return True
            i -= 1
        if not tries:
            found[chosen] = left
        return False

    extend((), room, room)
    ranked = sorted(found, key=lambda f: (found[f], len(f)))
    if found[ranked[0]] == 0:
        return ranked[:1]
    some = ranked if width is None else ranked[: 3 * width]
    return [f for f in some if not _dominated(f, room, stock)][:width] or ranked[:1]


def bin_completion(sizes: np.ndarray, capacity: int, width: int | None = WIDTH, nodes: int = NODES) -> list[list[int]]:
    """Containers as lists of positions in sizes (each between 1 and capacity), as few as the search finds.

    They are the least possible if they are as many as the total size needs, at which the search ends at once, or if width is None and the tree was
    searched before nodes were used up. Otherwise fewer may do.
    """
    best = best_fit_decreasing(sizes, capacity)
    least = -(-int(sizes.sum()) // capacity)
    if len(best) == least or not len(sizes):
        return best
    stock = _Stock(sizes)
    path: list[tuple[int, ...]] = []
    options: list[Iterator[tuple[int, ...]]] = []
    solution = None

    def open_node() -> None:
        big = stock.sizes[-1]
        stock.take(big)
        choice = fillings(stock, capacity - big, width)
        stock.put(big)
        options.append(iter([(big, *f) for f in choice]))

    open_node()
    fewest = len(best)
    while options and nodes > 0 and fewest > least:
        f = next(options[-1], None)
        if f is None:
            options.pop()
            if path:
                for s in path.pop():
                    stock.put(s)
            continue
        nodes -= 1
        for s in f:
            stock.take(s)
        path.append(f)
        if not stock.total:
            if len(path) < fewest:
                fewest, solution = len(path), list(path)
        elif len(path) + -(-stock.total // capacity) < fewest:
            open_node()
            continue
        for s in path.pop():
            stock.put(s)
    if solution is None:
        return best
    where: dict[int, list[int]] = {}
    for i in np.argsort(-sizes, kind="stable").tolist():
        where.setdefault(int(sizes[i]), []).append(i)
    return [[where[s].pop() for s in f] for f in solution]


def _pack_group(rounds: int, last: bool, capacity: int, width: int | None, nodes: int):
    """Pack one shard. Before the last round the emptiest containers, with at most SHARD_ITEMS / FAN_IN items, stay open (-1)."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        order = np.lexsort((t["piece"].to_numpy(), t["doc_id"].to_numpy()))
        sizes = t["tokens"].to_numpy()[order]
        container = np.full(len(sizes), -1, np.int64)
        base = (rounds << 52) | (int(key[0].as_py()) << 20)
        room = 0 if last else SHARD_ITEMS // FAN_IN
        packed = sorted(bin_completion(sizes, capacity, width, nodes), key=lambda items: (int(sizes[items].sum()), items))
        for n, items in enumerate(packed):
            if len(items) <= room and int(sizes[items].sum()) < capacity:
                room -= len(items)
            else:
                room = 0
                container[items] = base + n
        return t.take(pa.array(order)).select(["doc_id", "piece", "tokens"]).append_column("container", pa.array(container))

    return run


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, width: int | None = WIDTH, nodes: int = NODES) -> DataFrame:
    """doc_id, piece, first_token, tokens, container: a row per text, or per piece of a text longer than capacity.

    Pieces count from 0; all but the last have capacity tokens and a container of their own. Texts without tokens (null, empty) have one row with
    0 tokens and container null. Rows that repeat are packed as often as they stand, as pieces of one doc_id they keep apart only by
    container. A null doc_id is kept. Empty table: no rows. The same rows are packed in the same way, however they are partitioned; only the
    numbers of containers with a full piece may differ. width and nodes bound the search (see bin_completion); container_fill shows how near the result is to the least possible.
    """
    counted = materialize(count_tokens(documents, tokenizer or default_tokenizer()), "tokens")
    full = F.floor(F.col("tokens") / capacity)
    rest = F.col("tokens") % capacity
    sequence = F.when(full > 0, F.sequence(F.lit(0).cast("long"), full - F.when(rest == 0, 1).otherwise(0))).otherwise(F.array(F.lit(0).cast("long")))
    pieces = counted.withColumn("piece", F.explode(sequence)).select("doc_id", "piece", F.when(F.col("piece") < full, F.lit(capacity).cast("long")).otherwise(rest).alias("tokens"))
    own = pieces.where(F.col("tokens") == capacity)
    # full pieces: a container of their own, numbered far above the packed ones
    own = own.withColumn("container", F.lit(1 << 62).bitwiseOR(F.monotonically_increasing_id()))
    empty = pieces.where("tokens = 0").withColumn("container", F.lit(None).cast("long"))
    open_ = pieces.where((F.col("tokens") > 0) & (F.col("tokens") < capacity))
    done = [own, empty]
    shards, rounds = max(1, -(-open_.count() // SHARD_ITEMS)), 0
    while True:
        last = shards == 1
        tagged = open_.withColumn("_s", F.pmod(F.xxhash64(F.lit(rounds), "doc_id", "piece"), F.lit(shards)).cast("long"))
        packed = tagged.groupBy("_s").applyInArrow(_pack_group(rounds, last, capacity, width, nodes), "doc_id long, piece long, tokens long, container long")
        if last:
            done.append(packed)
            break
        packed = materialize(packed, f"packed{rounds}")
        done.append(packed.where("container >= 0"))
        open_ = packed.where("container < 0")
        shards, rounds = -(-shards // FAN_IN), rounds + 1
    out = done[0]
    for p in done[1:]:
        out = out.unionByName(p)
    return out.select("doc_id", "piece", (F.col("piece") * capacity).alias("first_token"), "tokens", "container")


def container_fill(packing: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """container, n_items, tokens, unused of every container."""
    per = packing.where("container is not null").groupBy("container").agg(F.count("*").alias("n_items"), F.sum("tokens").alias("tokens"))
    return per.withColumn("unused", F.lit(capacity) - F.col("tokens"))
