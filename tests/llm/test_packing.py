import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfield.llm import packing as P
from nearfield.llm.queries import p6_containers, p6_packing, p6_waste
from nearfield.plans.tables import table
from tests.oracle import DATA


def least_bins(sizes, capacity):
    """The optimum by trying all assignments."""
    sizes, best = sorted(sizes, reverse=True), len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms)}.values():
            if rooms[j] >= sizes[i]:
                place(i + 1, [*rooms[:j], rooms[j] - sizes[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


def valid(bins, sizes, capacity):
    assert sorted(itertools.chain(*bins)) == list(range(len(sizes)))
    assert all(0 < sizes[b].sum() <= capacity for b in bins)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_small_cases_are_optimal(sizes):
    a = np.array(sizes, np.int64)
    bins = P.bin_completion(a, 20, width=8)
    valid(bins, a, 20)
    assert len(bins) == least_bins(sizes, 20)


def test_search_beats_best_fit_decreasing():
    a = np.array([5, 4, 4, 3, 2, 2], np.int64)
    assert len(P.best_fit_decreasing(a, 10)) == 3
    assert len(P.bin_completion(a, 10)) == 2
    rng = np.random.default_rng(0)
    gains = 0
    for _ in range(20):
        s = rng.integers(200, 1100, 60)
        fit, done = P.best_fit_decreasing(s, 2048), P.bin_completion(s, 2048)
        valid(done, s, 2048)
        assert len(done) <= len(fit)
        gains += len(fit) - len(done)
    assert gains > 0


def test_the_search_ends_on_hard_cases():
    s = np.full(3000, 1100, np.int64)
    assert len(P.bin_completion(s, 2048, nodes=2000)) == 3000


def test_packing_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD_ITEMS", 40)
    monkeypatch.setattr(P, "FAN_IN", 4)
    rng = random.Random(1)
    rows = [(i, "word " * rng.randint(1, 150), i) for i in range(300)] + [(900, "word " * 700, 0), (901, None, 0), (902, "", 0), (None, "word", 0), (5, "word", 0), (5, "word", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, container long")
    got = P.pack_documents(d, 200).collect()
    counts = {r["doc_id"]: r["tokens"] for r in P.count_tokens(d.where("doc_id >= 6 and doc_id < 901"), P.default_tokenizer()).collect()}
    fill = {}
    for r in got:
        if r["container"] is None:
            assert r["doc_id"] in (901, 902) and r["tokens"] == 0
        else:
            fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
    assert max(fill.values()) <= 200
    total = sum(fill.values())
    assert len(fill) <= 1.05 * -(-total // 200) + 1
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, n in counts.items():
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert sum(r["tokens"] for r in pieces) == n and len(pieces) == max(1, -(-n // 200))
        assert [r["first_token"] for r in pieces] == [200 * k for k in range(len(pieces))]
    assert len(by_doc[None]) == 1 and len(by_doc[5]) == 3


def test_empty_table(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert P.pack_documents(d).count() == 0
    assert P.container_fill(P.pack_documents(d)).count() == 0


def test_queries(spark):
    n = table(spark, DATA, "documents").count()
    packing = p6_packing(spark, DATA)
    assert packing.select("doc_id").distinct().count() == n
    assert p6_containers(spark, DATA).where("tokens > 2048 or tokens <= 0").count() == 0
    r = p6_waste(spark, DATA).first()
    assert r["containers"] - r["least"] <= 1


@pytest.mark.parametrize("text", ["<|endoftext|> is ordinary text", "naïve – 文字 🙂", " \n "])
def test_tokens_round_trip(text):
    e = P.encoder(P.default_tokenizer())
    assert e.decode(e.encode_ordinary(text)) == text


def least_containers(sizes, capacity):
    """By trying every item in every container."""

    def fits(rest, rooms):
        if not rest:
            return True
        return any(rest[0] <= r and fits(rest[1:], rooms[:i] + [r - rest[0]] + rooms[i + 1 :]) for i, r in enumerate(rooms) if r not in rooms[:i])

    n = 0
    while not fits(sorted(sizes, reverse=True), [capacity] * n):
        n += 1
    return n


def test_complete_search_gives_the_least_number():
    rng = np.random.default_rng(1)
    for _ in range(40):
        sizes = rng.integers(1, 30, rng.integers(1, 10))
        bins = P.bin_completion(sizes, 40, width=None, nodes=10**6)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sizes[b].sum() <= 40 for b in bins)
        assert len(bins) == least_containers(sizes.tolist(), 40)
