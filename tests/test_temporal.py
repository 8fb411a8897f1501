"""Hand-made histories for the bitemporal reads."""

import random

import pytest
from pyspark.sql import functions as F

from chronoset.operators import maintenance, temporal
from chronoset.schema import OPEN_END

SCHEMA = "entity_id string, system_time_ns long, valid_time_start_ns long, valid_time_end_ns long, assertion_time_ns long, dot_node_id string, dot_counter long, payload_digest string, payload string, tier_rank int"


def facts(spark, *rows):
    """(entity, system, start, end, payload[, tier])"""
    full = [(e, s, vs, ve, s, "0" * 32, k, p, p, tier[0] if tier else 0) for k, (e, s, vs, ve, p, *tier) in enumerate(rows, 1)]
    return spark.createDataFrame(full, SCHEMA)


def payloads(df):
    return sorted(r.payload for r in df.collect())


LAND = (("land-001", 2015, 1990, 2000, "A"), ("land-001", 2018, 1995, 2005, "B"), ("land-001", 2020, 2005, 2025, "C"))


@pytest.mark.parametrize(("v", "tx", "want"), [(1995, 2021, ["B"]), (1992, 2021, ["A"]), (1995, 2016, ["A"]), (1995, 2018, ["B"]), (1995, 2017, ["A"]), (2005, 2021, ["C"]), (2025, 2021, []), (1995, 2014, [])])
def test_as_of(spark, v, tx, want):
    assert payloads(temporal.as_of(facts(spark, *LAND), v, tx)) == want


def test_as_of_one_entity(spark):
    rows = facts(spark, *LAND, ("land-002", 2019, 1990, 2030, "Z"))
    assert payloads(temporal.as_of(rows, 1995, 2021)) == ["B", "Z"]
    assert payloads(temporal.as_of(rows, 1995, 2021, "land-002")) == ["Z"]
    assert payloads(temporal.as_of(rows, 1995, 2021, "land-999")) == []
    with pytest.raises(ValueError):
        temporal.as_of(rows, 1995, 2021, "")


def test_as_of_never_takes_system_time_below_one(spark):
    rows = facts(spark, ("e", 0, 0, 10, "zero"), ("e", -5, 0, 10, "minus"))
    assert payloads(temporal.as_of(rows, 5, 100)) == []
    assert payloads(temporal.range_window(rows, 0, 10, 100)) == ["minus", "zero"]


def test_as_of_ties(spark):
    rows = facts(spark, ("e", 7, 2, 10, "late start"), ("e", 7, 1, 10, "early start"), ("f", 7, 1, 10, "live", 2), ("f", 7, 3, 10, "flushed", 1), ("f", 7, 4, 10, "compacted", 0))
    assert payloads(temporal.as_of(rows, 5, 7)) == ["compacted", "early start"]


def test_range(spark):
    rows = facts(spark, *(("e", 1000 + k, lo, hi, f"{lo}") for k, (lo, hi) in enumerate([(10, 20), (30, 40), (50, 60), (70, 80)])))
    assert payloads(temporal.range_window(rows, 25, 65, 5000)) == ["30", "50"]
    assert payloads(temporal.range_window(rows, 20, 30, 5000)) == []  # ends at lo, starts at hi
    with pytest.raises(ValueError):
        temporal.range_window(rows, 30, 30, 5000)


def test_range_cap(spark):
    rows = facts(spark, *(("e", 1000 + k, k, 100, f"{k}") for k in range(6)))
    for most, n, truncated in ((4, 4, True), (6, 6, False), (7, 6, False), (0, 6, False), (-1, 6, False)):
        found, more = temporal.range_capped(rows, 0, 50, 5000, "e", most)
        assert (found.count(), more) == (n, truncated)


def test_zero_width_interval(spark):
    rows = facts(spark, ("e", 1, 5, 5, "point"))
    assert payloads(temporal.range_window(rows, 0, 10, 5)) == ["point"]
    assert payloads(temporal.as_of(rows, 5, 5)) == []


def test_range_holds_every_as_of(spark):
    rows = facts(spark, ("e", 1000, 10, 50, "a"), ("e", 2000, 30, 70, "b"), ("e", 3000, 55, 90, "c"))
    window = set(payloads(temporal.range_window(rows, 10, 90, 5000)))
    for v in (10, 45, 60, 89):
        assert set(payloads(temporal.as_of(rows, v, 5000))) <= window


def test_coalesce_keeps_one_row_per_start(spark):
    rows = facts(spark, ("e", 1, 10, 20, "old"), ("e", 2, 10, 90, "new"), ("e", 1, 11, 20, "other"))
    assert payloads(temporal.coalesce_range(rows)) == ["new", "other"]


def test_live_rows(spark):
    rows = facts(spark, ("e", 1, 0, 9, "same", 0), ("e", 1, 0, 9, "same", 2), ("e", 2, 0, 9, "twice", 2), ("e", 2, 1, 9, "twice", 2), ("e", 9, 0, 9, "future", 2))
    assert payloads(temporal.live_merge_range(rows, 0, 9, 5)) == ["same", "twice"]


def test_timeline(spark):
    found = temporal.timeline(facts(spark, ("e", 1, 0, 100, "base"), ("e", 2, 20, 40, "patch")), 9)
    assert sorted((r.from_ns, r.to_ns, r.dot_counter) for r in found.collect()) == [(0, 20, 1), (20, 40, 2), (40, 100, 1)]


def test_two_rules_of_latest(spark):
    rows = spark.createDataFrame([("e", "01" * 16, 9), ("e", "02" * 16, 3), ("f", "02" * 16, 3), ("f", "01" * 16, 3)], "entity_id string, dot_node_id string, dot_counter long")
    assert {(r.entity_id, r.dot_node_id[:2]) for r in temporal.latest_dot(rows).collect()} == {("e", "01"), ("f", "01")}
    assert {(r.entity_id, r.dot_node_id[:2]) for r in temporal.checkpoint_latest(rows).collect()} == {("e", "02"), ("f", "02")}


@pytest.mark.parametrize(("horizon", "n"), [(200, 2), (250, 1), (1000, 1), (0, 2), (-1, 2)])
def test_prune_horizon(spark, horizon, n):
    assert maintenance.dominance_prune(facts(spark, ("e", 100, 0, 100, "r"), ("e", 250, 0, 100, "d")), horizon).count() == n


def test_prune_needs_containment(spark):
    assert maintenance.dominance_prune(facts(spark, ("e", 100, 0, 100, "r"), ("e", 200, 20, 80, "d"), ("f", 300, 0, 100, "x")), 1000).count() == 3


@pytest.mark.parametrize("seed, direct", [(0, False), (1, True), (2, None)])
def test_prune_against_brute_force(spark, seed, direct):
    rnd = random.Random(seed)
    rows = [("e", rnd.randrange(500), a := rnd.randrange(300), a + rnd.randrange(1, 300), str(k)) for k in range(300)]
    for horizon in (100, 300, 1000):
        want = sorted(r[4] for r in rows if not any(q[1] > r[1] and q[2] <= r[2] and q[3] >= r[3] and q[1] <= horizon for q in rows))
        once = maintenance.dominance_prune(facts(spark, *rows), horizon, direct)
        assert payloads(once) == want
    assert payloads(maintenance.dominance_prune(once, horizon)) == want


def test_stamps(spark):
    from chronoset.sources.facts import stamp_inserts

    rows = spark.createDataFrame([("a", "v", None, None), ("b", "v", 5, 10), ("c", "v", 5, 0), ("d", "v", OPEN_END - 1, 10), ("e", None, 5, 2**63 - 1), ("f", "v", -5, 10)], "key string, val string, valid_from_ns long, valid_for_ns long")
    got = {r.key: (r.valid_time_start_ns, r.valid_time_end_ns) for r in stamp_inserts(rows, F.lit(100)).collect()}
    assert got == {"a": (100, OPEN_END), "b": (5, 15), "c": (5, OPEN_END), "d": (OPEN_END - 1, OPEN_END), "e": (5, OPEN_END), "f": (-5, 5)}


def hot_history(seed, n=240):
    """Facts, half of them of one entity, with ties and odd intervals."""
    rnd = random.Random(seed)
    return [(rnd.choice("ehhh"), rnd.randrange(-3, 60), a := rnd.randrange(90), a + rnd.choice((-2, 0, 1, 1, 5, 20, 60)), str(k), rnd.randrange(3)) for k in range(n)]


def wins(rows, e, v, tx):
    """The payload of the fact that holds, by the written rule."""
    live = [(-s, t, a, s, k) for k, (en, s, a, b, _, t) in enumerate(rows) if en == e and 0 < s <= tx and a <= v < b]
    return rows[min(live)[-1]][4] if live else None


@pytest.mark.parametrize("seed, direct", [(0, False), (1, False), (0, True), (2, None)])
def test_joins_of_a_hot_entity_against_brute_force(spark, seed, direct):
    rnd, rows = random.Random(seed), hot_history(seed)
    frame = facts(spark, *rows)
    points = [(k, rnd.choice("ehhhz"), rnd.randrange(-5, 120), rnd.randrange(70)) for k in range(200)]
    got = {r.coord_id: r.payload for r in temporal.as_of_join(spark.createDataFrame(points, "coord_id long, entity_id string, valid_ns long, tx_ns long"), frame, direct).collect()}
    assert got == {k: wins(rows, e, v, tx) for k, e, v, tx in points}
    windows = [(k, rnd.choice("ehhz"), a := rnd.randrange(-5, 120), a + rnd.randrange(-1, 30), rnd.randrange(70)) for k in range(150)]
    found = temporal.range_join(spark.createDataFrame(windows, "window_id long, entity_id string, lo long, hi long, tx_ns long"), frame, direct)
    want = sorted((k, r[4]) for k, e, lo, hi, tx in windows for r in rows if hi > lo and r[0] == e and r[1] <= tx and r[2] < hi and r[3] > lo)
    assert sorted((r.window_id, r.payload) for r in found.collect()) == want
    held = {(r.entity_id, v): str(r.dot_counter - 1) for r in temporal.timeline(frame, 40, direct).collect() for v in range(r.from_ns, r.to_ns)}
    assert held == {(e, v): w for e in "eh" for v in range(160) if (w := wins(rows, e, v, 40)) is not None}


def test_one_entity_with_most_rows(spark):
    """20,000 rows of one entity beside few others: what is made on the way grows with rows times their logarithm, not with pairs."""
    n = 20_000
    rows = spark.range(2 * n).selectExpr("IF(id % 2 = 0, 'hot', concat('e', id % 997)) AS entity_id", "id + 1 AS system_time_ns", "(id * 7919) % 100003 AS valid_time_start_ns", "(id * 7919) % 100003 + id % 37 * 10 + 1 AS valid_time_end_ns", "id AS assertion_time_ns", "lpad('0', 32, '0') AS dot_node_id", "id AS dot_counter", "'' AS payload_digest", "'' AS payload", "0 AS tier_rank")
    from chronoset.operators.intervals import pairs_are_few

    assert not pairs_are_few(rows, rows, "entity_id")
    kept = maintenance.dominance_prune(rows, 10**9)
    hot = rows.where("entity_id = 'hot'").toPandas().sort_values("system_time_ns", ascending=False)
    start, end = hot.valid_time_start_ns.to_numpy(), hot.valid_time_end_ns.to_numpy()
    want = sum(not ((start[:k] <= start[k]) & (end[:k] >= end[k])).any() for k in range(len(hot)))
    assert kept.where("entity_id = 'hot'").count() == want < n
    points = rows.selectExpr("dot_counter AS coord_id", "entity_id", "valid_time_start_ns AS valid_ns", "system_time_ns AS tx_ns")
    assert temporal.as_of_join(points, rows).where("dot_counter = coord_id").count() == 2 * n  # each is the latest at its own place and time


def test_next_in_key(spark):
    from chronoset.operators.ordered import next_in_key

    rows = [("a" if k % 5 else "b", k, k * k) for k in range(300)]
    got = {r.o: (r.then, r._nexto) for r in next_in_key(spark.createDataFrame(rows, "k string, o long, v long"), ["k"], ["o"], "v", "then", "o").collect()}
    for key in "ab":
        own = [r for r in rows if r[0] == key]
        assert [got[r[1]] for r in own] == [(r[2], r[1]) for r in own[1:]] + [(None, None)]
