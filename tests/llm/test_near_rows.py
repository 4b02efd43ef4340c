"""One row of each group stays, whatever its ids are."""

import random
import time

import numpy as np

from tests.llm import brute
from tidelog.llm import near_dedup

LONG = " ".join(f"w{i}" for i in range(60))
OTHER = " ".join(f"v{i}" for i in range(60))
THIRD = " ".join(f"u{i}" for i in range(60))


def test_repeated_rows_and_null_ids(spark):
    rows = [(4, LONG, "a"), (4, LONG, "b"), (4, LONG + " more", "c"), (7, LONG, "d"), (None, LONG, "e"), (None, OTHER, "f"), (None, OTHER, "g"), (None, OTHER + " more", "h"), (4, THIRD, "i"), (9, THIRD, "j")]
    rows += [(1, "", "k"), (1, "", "l"), (2, " ", "m"), (3, None, "n"), (None, "", "o"), (None, "", "p")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, more string").repartition(4)
    out = near_dedup.deduplicated(d)
    kept = out.collect()
    assert out.columns == d.columns and len(kept) == len({r["more"] for r in kept})
    for group, n in (("abcde", 1), ("fgh", 1), ("ij", 1), ("kl", 1), ("m", 1), ("n", 1), ("op", 1)):
        assert sum(r["more"] in group for r in kept) == n
    assert all(r["more"] in "abci" for r in kept if r["text"] and r["text"].strip() and not r["text"].startswith("v"))


def test_null_ids_alone(spark):
    d = spark.createDataFrame([(None, LONG), (None, LONG + " more"), (None, OTHER)], "doc_id bigint, text string")
    assert near_dedup.deduplicated(d).count() == 2


def test_a_block_of_connected_texts_is_fast():
    """2,000 texts with one core: once connected, they aren't compared again."""
    r = random.Random(1)
    core = [f"w{r.randrange(5000)}" for _ in range(200)]
    texts = [" ".join(core[:k] + [f"x{i}"] + core[k + 1 :]) for i in range(2000) for k in [r.randrange(200)]]
    sets = [near_dedup.shingles(t) for t in texts]
    packed, sizes = np.array([near_dedup.sketch(s)[1] for s in sets]), np.array([len(s) for s in sets])
    began = time.time()
    assert len(near_dedup.links_within(np.arange(2000), texts, 85, 5, packed, sizes)) == 1999
    assert time.time() - began < 2


def test_large_groups_by_chunks(spark, monkeypatch):
    """A group of near copies and a chain, far over the size of a chunk, with the links that brute force finds."""
    monkeypatch.setattr(near_dedup, "CHUNK", 25)
    r = random.Random(4)
    core = [f"w{r.randrange(5000)}" for _ in range(150)]
    words = [f"v{r.randrange(10**6)}" for _ in range(900)]
    near = [" ".join(core[:k] + [f"x{i}"] + core[k + 1 :]) for i in range(30) for k in [r.randrange(150)]]
    far = [" ".join(f"y{i}" if r.random() < 0.06 else w for w in core) for i in range(20)]
    chain = [" ".join(words[i * 6 : i * 6 + 200]) for i in range(24)]
    rows = list(enumerate(near + far + chain))
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.report(d).collect()}
    sets = [brute.shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {i: find(i) for i in range(len(rows))}
