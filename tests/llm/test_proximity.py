"""Proximity matches against brute force."""

import random

import pytest

from tests.llm.brute import PLAIN, UPPER
from tidelog.llm import decontaminate
from tidelog.llm.queries import queries

WINDOW = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def plain_words(text):
    return PLAIN.findall((text or "").translate(UPPER))


def brute(docs, items, slop=5, least=8, width=10):
    windows = {}
    for i, t in items:
        w = plain_words(t)
        for a in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[a : a + width]), set()).add(str(i))
    out = []
    for d, t in docs:
        w = plain_words(t)
        for x, own in windows.items():
            places = range(1 - len(x) - slop, len(w) + slop + 1)
            n, back = max(((len(set(x) & set(w[max(0, s - slop - 1) : max(0, s + len(x) - 1 + slop)])), -s) for s in places), default=(0, 0))
            if n >= least:
                out.append((d, sorted(own), -back, n))
    return sorted(out)


def brute_by_sets(docs, items):
    """brute() for pairs of a document and an item that have `least` terms in common at all."""
    for d, t in docs:
        w = set(plain_words(t))
        near = [(i, x) for i, x in items if len(w & set(plain_words(x))) >= 8]
        yield from brute([(d, t)], near) if near else ()


def got(spark, docs, items, **more):
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")
    return sorted((r["id"], r["items"], r["start"], r["terms"]) for r in decontaminate.proximity(d, i, **more).collect())


def test_any_two_terms_may_be_missing(spark):
    """Also the rarest, and ones that no document has."""
    w = WINDOW.split()
    docs = [(i * 10 + j, "some words before " + " ".join("other" if k in (i, j) else x for k, x in enumerate(w)) + " and behind") for i in range(10) for j in range(i, 10)]
    want = brute(docs, [(1, WINDOW)])
    assert {d for d, *_ in want} == {d for d, _ in docs} and got(spark, docs, [(1, WINDOW)]) == want
    docs, items = [(1, WINDOW.replace("kappa", "kapa"))], [(1, WINDOW)]
    assert brute(docs, items) == got(spark, docs, items) != []


@pytest.mark.parametrize("most", [200_000, 3])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", most)
    r = random.Random(5)
    words = WINDOW.split() + [f"w{i}" for i in range(12)]
    items = [(i, " ".join(r.choices(words, k=r.choice([3, 10, 14])))) for i in range(6)] + [(7, WINDOW), (8, None)]
    docs = [(i, " ".join(r.choices(words, k=r.randrange(40)))) for i in range(60)] + [(99, None)]
    for slop, least in ((5, 8), (2, 7), (0, 6)):
        want = brute(docs, items, slop, least)
        assert want and got(spark, docs, items, slop=slop, least=least) == want


def test_registered(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    found = {}
    for d, own, _, terms in brute_by_sets([(r["doc_id"], r["text"]) for r in docs.collect()], items):
        n, most, names = found.get(d, (0, 0, set()))
        found[d] = (n + 1, max(most, terms), names | set(own))
    out = queries()["op10_proximity"](spark, small).collect()
    assert {r["doc_id"]: (r["n_windows"], r["most_terms"], r["n_items"]) for r in out} == {d: (n, m, len(x)) for d, (n, m, x) in found.items()} != {}
