"""Evaluation passages inside training texts, by suffix arrays over shards of the corpus.

Each task reads its documents into shards of a bounded number of words. Words that occur in no passage can't be part
of a match, so only runs of at least min_words known words enter the shard's array; they are cut, never the text. The
suffixes of that array are sorted by prefix doubling, every suffix of every passage is found in it by binary search,
all at once, and each hit is extended to its longest verbatim match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm import markup
from nearfield.session import materialize

#: Consecutive words that make a leak.
MIN_WORDS = 12
#: Words of documents in one suffix array: bounds the memory of a task.
SHARD_WORDS = 2_000_000
#: Occurrences of passage suffixes looked at together in a shard.
MATCHES = 2_000_000
#: Passages sent to the tasks at once: the bound of what is broadcast.
ITEM_BLOCK = 20_000


class Passages:
    """Word sequences of test items as numbers: one array, items one after another, each closed by a 0."""

    def __init__(self, ids: list[int], texts: list[str | None], min_words: int):
        self.min_words = min_words
        self.vocabulary: dict[str, int] = {}
        sequences, self.items = [], []
        for i, t in zip(ids, texts):
            w = markup.words(t) if t else []
            if len(w) >= min_words:
                sequences.append(np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w] + [0], np.int32))
                self.items.append(i)
        self.array = np.concatenate(sequences) if sequences else np.zeros(0, np.int32)
        lengths = np.array([len(s) for s in sequences], np.int64)
        self.owner = np.repeat(np.arange(len(sequences)), lengths)
        ends = np.repeat(np.cumsum(lengths) - 1, lengths)
        self.left = ends - np.arange(len(self.array))
        self.starts = np.nonzero(self.left >= min_words)[0]
        self.longest = int(lengths.max()) if len(lengths) else 0


def suffix_array(a: np.ndarray, depth: int) -> np.ndarray:
    """Start positions of the suffixes of a in order of their first depth values, by prefix doubling."""
    n = len(a)
    rank = np.unique(a, return_inverse=True)[1].astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while k < depth:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        rank, k = new, 2 * k
        if n and rank.max() == n - 1:
            break
    return order


def _bound(text: np.ndarray, order: np.ndarray, wanted: np.ndarray, upper: bool) -> np.ndarray:
    """For each row of wanted, how many suffixes of text (padded, in order) begin with something less, or with upper also with just that."""
    lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order), np.int64)
    width = np.arange(wanted.shape[1])
    rows = np.arange(len(wanted))
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        got = text[order[np.minimum(mid, len(order) - 1)][:, None] + width]
        differ = got != wanted
        at = differ.argmax(axis=1)
        same = ~differ.any(axis=1)
        less = np.where(same, upper, got[rows, at] < wanted[rows, at])
        lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
    return lo


def known_runs(words: list[str], vocabulary: dict[str, int], min_words: int) -> list[tuple[int, np.ndarray]]:
    """(position, numbers) of each run of at least min_words words that occur in passages."""
    get = vocabulary.get
    v = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
    edge = np.diff(np.concatenate([[0], (v > 0).astype(np.int8), [0]]))
    begin, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    return [(int(b), v[b:e]) for b, e in zip(begin, end) if e - b >= min_words]


def match_shard(runs: list[tuple[int, int, np.ndarray]], p: Passages) -> list[tuple[int, int, int, int, int]]:
    """(document, item, position in the document, position in the passage, words) of each match that can't be extended to the left."""
    m = p.min_words
    if not runs or not len(p.starts):
        return []
    sizes = np.array([len(r[2]) + 1 for r in runs], np.int64)
    text = np.concatenate([np.append(r[2], 0) for r in runs]).astype(np.int32)
    padded = np.concatenate([text, np.zeros(max(m, p.longest) + 1, np.int32)])
    order = suffix_array(text, p.longest)
    wanted = p.array[p.starts[:, None] + np.arange(m)]
    first, last = _bound(padded, order, wanted, False), _bound(padded, order, wanted, True)
    hits = last - first
    if not hits.sum():
        return []
    found_q, found_t = [], []
    cuts = np.unique(np.searchsorted(np.cumsum(hits), np.arange(0, hits.sum() + MATCHES, MATCHES), "right"))
    for a, b in zip(cuts[:-1], cuts[1:]):  # a bounded number of occurrences at once; those that continue another are dropped at once
        n = hits[a:b]
        q = np.repeat(p.starts[a:b], n)
        t = order[np.repeat(first[a:b], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        before_q, before_t = p.array[np.maximum(q - 1, 0)], padded[np.maximum(t - 1, 0)]
        maximal = (q == 0) | (t == 0) | (before_q != before_t) | (before_q == 0)
        found_q.append(q[maximal]), found_t.append(t[maximal])
    q, t = np.concatenate(found_q), np.concatenate(found_t)
    length = np.full(len(q), m, np.int64)
    grow = np.arange(len(q))
    while len(grow):
        qi, ti = q[grow] + length[grow], t[grow] + length[grow]
        ok = (p.array[qi] == padded[ti]) & (p.array[qi] != 0)
        grow = grow[ok]
        length[grow] += 1
    run = np.repeat(np.arange(len(runs)), sizes)[t]
    begin = np.cumsum(sizes) - sizes
    item_begin = np.concatenate([[0], np.nonzero(p.array == 0)[0] + 1])
    out = []
    for r, ti, qi, k in zip(run, t, q, length):
        doc, pos, _ = runs[r]
        o = p.owner[qi]
        out.append((doc, p.items[o], int(pos + ti - begin[r]), int(qi - item_begin[o]), int(k)))
    return out


def find_leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, item_id, doc_word, item_word, n_words: every maximal verbatim match of at least min_words words.

    Texts and passages are compared as a reader sees them (see markup.words); captions and arguments of templates that show nothing in
    place are searched by themselves, and doc_word counts on through them behind the running text. Items with the same passage are all reported. Null or
    short passages and null or empty texts match nothing; repeated rows repeat their matches. Documents are read where they lie, whole, without a shuffle. Passages go out in blocks of
    ITEM_BLOCK; with several, the words of the documents are cut and written once, and each block is finished and released before the next.
    """
    spark = documents.sparkSession
    names, kinds = ["doc_id", "item_id", "doc_word", "item_word", "n_words"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    schema = "doc_id long, item_id long, doc_word int, item_word int, n_words int"
    wanted = items.where("passage is not null").select(F.col("item_id").cast("long").alias("item_id"), "passage")
    blocks = max(1, -(-wanted.count() // ITEM_BLOCK))
    src = documents.where("text is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([markup.passages(t) for t in part.column(1).to_pylist()], pa.list_(pa.list_(pa.string())))], ["doc_id", "words"])

    def search(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = sent.value

            def flush(runs):
                cols = list(zip(*match_shard(runs, p))) or [[]] * 5
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

            runs, held = [], 0
            for batch in batches:
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    begin = 0
                    for words in t if blocks > 1 else markup.passages(t):
                        for pos, v in known_runs(words, p.vocabulary, min_words):
                            runs.append((d, begin + pos, v))
                            held += len(v) + 1
                        begin += len(words)
                    if held >= SHARD_WORDS:
                        yield flush(runs)
                        runs, held = [], 0
            yield flush(runs)

        return run

    if blocks > 1:
        src = materialize(src.mapInArrow(cut, "doc_id long, words array<array<string>>"), "words")
    out = None
    for b in range(blocks):
        rows = (wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)) == b)).toArrow()
        sent = spark.sparkContext.broadcast(Passages(rows["item_id"].to_pylist(), rows["passage"].to_pylist(), min_words))
        found = src.mapInArrow(search(sent), schema)
        if blocks > 1:
            found = materialize(found, "leaks")
            sent.destroy()
        out = found if out is None else out.unionAll(found)
    return out


def without_leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents that hold no passage, all columns."""
    return documents.join(find_leaks(documents, items, min_words).select("doc_id").distinct(), "doc_id", "left_anti")
