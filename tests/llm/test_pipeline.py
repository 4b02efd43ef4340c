"""The pipeline's stages against brute force, each on what its predecessor kept."""

import pytest

import corpus_pipeline as cp
from tests.llm import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    for name, f in cp.STAGES:
        before = docs
        f(spark, docs, small).write.parquet(f"file://{folder}/{name}")
        docs = spark.read.parquet(f"file://{folder}/{name}")
        out.append((name, before, docs))
    return {n: (a, b) for n, a, b in out}


def local(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_order():
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "mixing"]


def test_columns(stages):
    for name, (_, after) in stages.items():
        if name != "mixing":
            assert after.columns == COLUMNS


def test_quality(stages):
    a, b = map(local, stages["quality_rules"])
    failed = {d for d, r in a.items() if brute.quality(r["text"])[-1]}
    assert not failed & set(b) and all(a[d] == b[d] for d in b) and len(b) > 0.8 * (len(a) - len(failed))


def test_lines(stages):
    a, b = map(local, stages["line_dedup"])
    want = {d: s for d, _, _, s in brute.lines([(d, r["text"]) for d, r in a.items()])}
    assert {d: brute.sha(r["text"]) for d, r in b.items()} == want


def test_near(stages):
    a, b = map(local, stages["near_dedup"])
    assert set(b) == {d for d, _, _, kept in brute.near([(d, r["text"]) for d, r in a.items()], 80) if kept}


def test_leaks(spark, small, stages):
    a, b = map(local, stages["decontaminate"])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert set(b) == {d for d, *_, bad in brute.leaks([(d, r["text"]) for d, r in a.items()], items) if not bad}


def test_mixing(stages):
    a, after = stages["mixing"]
    docs, out = local(a), after.collect()
    want = brute.mixing([(d, r["text"], r["source"]) for d, r in docs.items()])
    taken = {}
    for r in out:
        s = docs[r["doc_id"]]["source"]
        taken[s] = taken.get(s, 0) + r["taken"]
        assert r["target"] == pytest.approx(want[s][1])
    assert len(out) == len(docs) and all(abs(n - want[s][1]) <= 1 for s, n in taken.items())


def test_run_equals_the_stages(spark, small, stages):
    assert sorted(map(str, cp.run(spark, small).collect())) == sorted(map(str, stages["mixing"][1].collect()))
