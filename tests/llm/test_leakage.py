import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfield.llm import leakage as L
from nearfield.llm.markup import words
from nearfield.llm.queries import p7_clean, p7_found, p7_items, p7_matches
from nearfield.plans.tables import table
from tests.oracle import DATA


def brute(docs, items, m):
    out = set()
    for d, t in docs:
        w = words(t or "")
        grams = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}
        for i, p in items:
            v = words(p or "")
            if any(tuple(v[j : j + m]) in grams for j in range(len(v) - m + 1)):
                out.add((d, i))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array_sorts_all_suffixes(a):
    order = L.suffix_array(np.array(a, np.int32), 64)
    assert [a[i:] for i in order.tolist()] == sorted(a[i:] for i in range(len(a)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25), max_size=4), st.lists(st.lists(st.sampled_from("abcd"), max_size=25), max_size=5))
def test_matches_agree_with_brute_force(passages, docs):
    items = [(i, " ".join(p)) for i, p in enumerate(passages)]
    texts = [(i, " ".join(d)) for i, d in enumerate(docs)]
    p = L.Passages([i for i, _ in items], [t for _, t in items], 3)
    runs = [(d, pos, v) for d, t in texts for pos, v in L.known_runs(words(t), p.vocabulary, 3)]
    found = L.match_shard(runs, p)
    assert {(d, i) for d, i, *_ in found} == brute(texts, items, 3)
    by_doc, by_item = dict(texts), dict(items)
    for d, i, at, start, n in found:
        w, v = words(by_doc[d]), words(by_item[i])
        assert w[at : at + n] == v[start : start + n]
        assert at + n == len(w) or start + n == len(v) or w[at + n] != v[start + n]
        assert at == 0 or start == 0 or w[at - 1] != v[start - 1]


def test_query_on_the_tables_agrees_with_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, DATA, "documents").collect()]
    items = [(r["item_id"], r["passage"]) for r in table(spark, DATA, "eval_items").collect()]
    want = brute(docs, items, 12)
    assert want and {tuple(r) for r in p7_found(spark, DATA).collect()} == want
    assert p7_items(spark, DATA).count() == len({i for _, i in want})
    assert p7_clean(spark, DATA).count() == len(docs) - len({d for d, _ in want})
    assert p7_matches(spark, DATA).where("n_words < 12").count() == 0


@pytest.fixture(scope="module")
def passage():
    rng = random.Random(4)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30))


def test_edges(spark, passage):
    w = passage.split()
    docs = [
        (1, passage.upper()),
        (2, "[[x|" + w[0] + "]] '''" + "''' <!-- c --> {{t}} ".join(w[1:13])),
        (3, " ".join(w[:11])),
        (4, " ".join(w[:6] + ["zzz"] + w[6:20])),
        (5, None),
        (6, ""),
        (7, ("filler words here " * 30_000) + " ".join(w[10:22])),
        (1, passage.upper()),
    ]
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, passage), (2, passage), (3, None), (4, "too short"), (5, "")], "item_id long, passage string")
    got = {(r["doc_id"], r["item_id"]) for r in L.find_leaks(d, items).collect()}
    assert got == {(x, i) for x in (1, 2, 4, 7) for i in (1, 2)}
    assert L.find_leaks(d.limit(0), items).count() == 0 and L.find_leaks(d, items.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in L.without_leaks(d, items).collect()) == [3, 5, 6]


def test_blocks_of_passages(spark, passage, monkeypatch):
    monkeypatch.setattr(L, "ITEM_BLOCK", 2)
    items = spark.createDataFrame([(i, passage + f" end{i}") for i in range(7)], "item_id long, passage string")
    d = spark.createDataFrame([(1, passage)], "doc_id long, text string")
    assert {r["item_id"] for r in L.find_leaks(d, items).collect()} == set(range(7))


SAID = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november"


@pytest.mark.parametrize(
    ("text", "at"),
    [
        ("one two {{Quote|" + SAID + "|Author}} three", 2),
        ("one {{ blockquote\n|text = " + SAID + "\n|author=X}}", 1),
        ("one {{Quote|alpha bravo charlie [[delta|delta]] {{lang|fr|echo}} foxtrot golf hotel}} india {{nowrap|juliet kilo}} lima{{citation needed|date=May 2012}} mike november", 1),
        ("{{Infobox place|name=X|note=" + SAID + "}} one two", 3),
        ("one [[File:a.jpg|thumb|" + SAID + "]]", 2),
        ("one {{unknown|{{Quote|" + SAID + "}}}}", 1),
        ("{|\n|-\n| one || " + SAID + "\n|}", 1),
        ("one <gallery>\nFile:a.jpg|" + SAID + "\n</gallery>", 4),
        ("one <div style='x'>" + SAID.replace(" golf", "<ref name=a>zulu</ref> golf<!-- yankee -->").replace("kilo", "ki&shy;lo") + "</div>", 1),
    ],
)
def test_passages_in_templates_and_captions_are_found(spark, text, at):
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(7, SAID)], "item_id long, passage string")
    assert [tuple(r) for r in L.find_leaks(d, items).collect()] == [(1, 7, at, 0, 14)]
    assert L.without_leaks(d, items).count() == 0
