"""Operations of the load generator."""

from tidelog.operators import load


def test_keys_keep_every_digit(spark):
    """The number of a key has five digits at least, as the generator's %05d, and no two writes share a key."""
    rows = spark.createDataFrame([(3, n) for n in (7, 99_996, 100_000, 100_001, 100_009)], "worker bigint, operation bigint")
    got = {r["operation"]: r["key"].removeprefix("load-client-03-write-") for r in load.described(rows).collect()}
    assert got == {7: "00006", 99_996: "99996", 100_000: "100000", 100_001: "100001", 100_009: "100006"}
