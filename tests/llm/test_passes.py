"""Every pass of a repeated source has its place in training."""

import pytest

from tidelog.llm import mixing


def test_passes(spark):
    rows = [(i, "w " * (3 + i % 5), "a") for i in range(40)] + [(100 + i, "w " * 200, "b") for i in range(40)] + [(200 + i, "w " * 100, "c") for i in range(40)]
    rows.append((300, None, "a"))
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    out, once = mixing.passes(d).collect(), mixing.mixed(d).collect()
    taken, first = {}, {}
    for r in out:
        taken[r["id"]] = taken.get(r["id"], 0) + r["taken"]
        if r["pass"] == 0:
            first[r["id"]] = r["position"]
    assert taken == {r["id"]: r["taken"] for r in once if r["taken"]}
    assert first == {r["id"]: pytest.approx(r["position"]) for r in once if r["taken"]}
    places = [r["position"] for r in out]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1
    a = [r for r in out if r["source"] == "a"]
    assert {r["pass"] for r in a} == {0, 1, 2} and max(r["position"] for r in a) > 0.95
    # Words up to any time follow the source's schedule.
    tilt, target, before = mixing.TILTS[0], next(r["target"] for r in once if r["source"] == "a"), 0
    for r in a:
        t = r["position"]
        assert before == pytest.approx(target * (t + tilt * (t * t - t)))
        before += r["taken"]
