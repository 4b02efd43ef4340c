"""Quorum, commit and membership operators, the commit index against the loop that defines it."""

import random

from pyspark.sql import functions as F

from tidelog.operators import quorum


def voters(spark, **configs):
    return spark.createDataFrame([(c, n) for c, ns in configs.items() for n in ns], "config string, node_id bigint")


def has(spark, v, acked):
    return quorum.quorum(v, spark.createDataFrame([(n,) for n in acked], "node_id bigint")).first()["has_quorum"]


def test_joint_quorum_is_no_union_majority(spark):
    grow = voters(spark, old=(1, 2, 3), new=(1, 2, 3, 4))
    assert not has(spark, grow, (1, 4))
    assert has(spark, grow, (2, 3, 4))
    assert not has(spark, voters(spark, old=(1, 2, 3), new=(1, 2, 3, 4, 5)), (3, 4, 5))
    assert not has(spark, voters(spark, stable=(1, 2, 3)), (1, 7, 8, 9))
    assert has(spark, voters(spark, stable=(1,)), (1, 1))


def test_commit_index_equals_the_defining_loop(spark):
    r = random.Random(5)
    rows, matches, leaders, want = [], [], [], {}
    terms = {i: 1 + (i > 12) + (i > 25) for i in range(1, 41)}
    for key in range(10, 210):
        configs = {"old": [key, -1, -2][: r.randint(1, 3)]}
        if r.random() < 0.5:
            configs["new"] = [key, -2, -3, -4] if r.random() < 0.5 else [-1, -2, -3]
        last, old, term = r.randint(0, 40), r.randint(0, 20), r.randint(1, 3)
        match = {n: r.randint(0, last) for n in (-1, -2, -3, -4) if r.random() < 0.8}
        rows += [(key, c, n) for c, ns in configs.items() for n in ns]
        matches += [(key, n, m) for n, m in match.items()]
        leaders.append((key, term, old, last))
        want[key] = old
        for n in range(last, old, -1):
            acked = {key} | {i for i, m in match.items() if m >= n}
            if terms[n] == term and all(sum(i in acked for i in ns) >= len(ns) // 2 + 1 for ns in configs.values()):
                want[key] = n
                break
    got = quorum.commit_index(
        spark.createDataFrame(rows, "leader_id bigint, config string, node_id bigint"),
        spark.createDataFrame(matches, "leader_id bigint, node_id bigint, match_index bigint"),
        spark.createDataFrame(list(terms.items()), "log_index bigint, term bigint"),
        spark.createDataFrame(leaders, "leader_id bigint, current_term bigint, commit_index bigint, last_index bigint"),
    )
    # Terms must not fall behind a leader's own: the loop and the closed form agree where a log's last term is at most the current one.
    fair = {k for k, t, _, last in leaders if last == 0 or terms[last] <= t}
    assert {r["leader_id"]: r["commit_index"] for r in got.collect() if r["leader_id"] in fair} == {k: v for k, v in want.items() if k in fair}


def test_membership_is_joint_on_append_and_stable_on_commit(spark):
    entries = spark.createDataFrame([(1, 3, 2), (1, 5, 1), (2, 3, 2), (2, 5, 1), (2, 8, 2), (3, 4, 1)], "node_id bigint, log_index bigint, mode int")
    commits = spark.createDataFrame([(1, 4), (2, 9), (3, 0)], "node_id bigint, commit_index bigint")
    got = {r[0]: tuple(r)[1:] for r in quorum.effective_membership(entries, commits).select("node_id", "log_index", "mode", "pending_stable").collect()}
    assert got == {1: (3, 2, 5), 2: (8, 2, None)}


def test_configuration_changes(spark):
    d = spark.range(1).select(F.create_map(F.lit(1).cast("decimal(20,0)"), F.lit("a"), F.lit(2).cast("decimal(20,0)"), F.lit("b")).alias("c"))
    three = F.lit(3).cast("decimal(20,0)")
    row = d.select(quorum.add_voter(F.col("c"), three, F.lit("x")).alias("more"), quorum.remove_voter(F.col("c"), F.lit(1).cast("decimal(20,0)")).alias("less"), quorum.valid_configuration(F.col("c")).alias("ok"), quorum.sorted_voters(F.col("c")).alias("s")).first()
    assert len(row["more"]) == 3 and list(row["less"].values()) == ["b"] and row["ok"] and [int(v["node_id"]) for v in row["s"]] == [1, 2]


def test_votes(spark):
    votes = spark.createDataFrame([(1, 1, 9, True), (1, 1, 9, True), (1, 2, 9, True), (1, 7, 9, True), (2, 1, 8, True)], "term bigint, voter_id bigint, candidate_id bigint, granted boolean")
    got = {(r["term"], r["granted"], r["has_quorum"]) for r in quorum.tally(votes, voters(spark, stable=(1, 2, 3))).collect()}
    assert got == {(1, 2, True), (2, 1, False)}


def test_recent_contact(spark):
    d = spark.createDataFrame([("leader", None), ("follower", 900_000), ("follower", 500_000), ("follower", None)], "role string, last bigint")
    assert [r[0] for r in d.select(quorum.recent_contact(F.col("role"), F.lit(1_000_000), F.col("last"))).collect()] == [True, True, False, False]
