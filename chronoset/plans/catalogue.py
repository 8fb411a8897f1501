"""Every registered query with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import admission, convergence, maintenance, recovery, replica, sketch, temporal
from ..operators.ordered import rank_in_key
from ..schema import DAY_NS, OPEN_END
from ..sources import facts as src
from ..sources import layout
from ..sources.facts import LIVE, table
from ..sources.shared import new_path
from ..streaming import ingest

#: The point, window and system time at which the registered queries read.
V, LO, HI, TX = 1705190400000000000, 1705190400000000000, 1705600000000000000, 1705400000000000000
SIX_HOURS_US = 21_600_000_000
NODE = "0" * 32

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_FACTS = f"""
WITH e AS (SELECT *, epoch_us(ts) AS us FROM events),
f0 AS (SELECT *, us - us % %GRAIN% AS cut, (us - us % 86400000000) * 1000 - (event_id % 7) * {DAY_NS} AS vs FROM e),
facts AS (SELECT event_id AS seq, 'user-' || CAST(user_id AS VARCHAR) AS entity_id, cut * 1000 AS system_time_ns, vs AS valid_time_start_ns,
  CASE WHEN event_id % 3 = 0 THEN {OPEN_END} ELSE vs + (event_id % 11 + 1) * {DAY_NS} END AS valid_time_end_ns, cut * 1000 AS assertion_time_ns,
  sha256(props) AS payload_digest, props AS payload, lpad(CAST(event_id % 4 AS VARCHAR), 32, '0') AS dot_node_id, event_id + 1 AS dot_counter,
  CASE WHEN event_id % 5 = 0 THEN 2 WHEN event_id % 5 < 3 THEN 1 ELSE 0 END AS tier_rank FROM f0)
"""
PLAIN, TIED = _FACTS.replace("%GRAIN%", "1"), _FACTS.replace("%GRAIN%", str(SIX_HOURS_US))
ROW = ("entity_id", "system_time_ns", "valid_time_start_ns", "valid_time_end_ns", "dot_node_id", "dot_counter", "payload_digest")
_ROW = ", ".join(ROW)
_ORDER = "system_time_ns DESC, tier_rank, valid_time_start_ns, assertion_time_ns, dot_node_id, dot_counter"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def facts(spark: SparkSession, sf_dir: str, tied: bool = False) -> DataFrame:
    return src.facts_from_events(table(spark, sf_dir, "events"), SIX_HOURS_US if tied else 1)


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).withColumn("origin_node_id", F.col("dot_node_id"))


# ---- bitemporal reads


def _as_of_sql(base: str) -> str:
    return base + f"SELECT {_ROW} FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY {_ORDER}) AS r FROM facts WHERE system_time_ns <= {TX} AND system_time_ns > 0 AND valid_time_start_ns <= {V} AND valid_time_end_ns > {V}) WHERE r = 1"


@query(_as_of_sql(PLAIN))
def as_of(spark, d):
    return temporal.as_of(facts(spark, d), V, TX).select(*ROW)


@query(_as_of_sql(TIED))
def as_of_tied(spark, d):
    return temporal.as_of(facts(spark, d, tied=True), V, TX).select(*ROW)


@query(_as_of_sql(PLAIN) + " AND entity_id = 'user-7'")
def as_of_entity(spark, d):
    return temporal.as_of(facts(spark, d), V, TX, "user-7").select(*ROW)


@query(
    PLAIN
    + f""", coords AS (SELECT o_orderkey AS coord_id, 'user-' || CAST(o_custkey AS VARCHAR) AS entity_id, {LO} + (o_orderkey % 20) * {DAY_NS} AS valid_ns, {TX} + (o_orderkey % 9) * {DAY_NS} AS tx_ns FROM orders),
j AS (SELECT c.coord_id, c.entity_id, c.valid_ns, c.tx_ns, f.system_time_ns, f.dot_node_id, f.dot_counter, row_number() OVER (PARTITION BY c.coord_id ORDER BY f.system_time_ns DESC, f.tier_rank, f.valid_time_start_ns, f.assertion_time_ns, f.dot_node_id, f.dot_counter) AS r
  FROM coords c LEFT JOIN facts f ON c.entity_id = f.entity_id AND f.system_time_ns <= c.tx_ns AND f.system_time_ns > 0 AND f.valid_time_start_ns <= c.valid_ns AND f.valid_time_end_ns > c.valid_ns)
SELECT coord_id, entity_id, valid_ns, tx_ns, coalesce(system_time_ns, -1) AS system_time_ns, dot_node_id, coalesce(dot_counter, -1) AS dot_counter FROM j WHERE r = 1"""
)
def as_of_join(spark, d):
    k = F.col("o_orderkey")
    coords = table(spark, d, "orders").select(k.alias("coord_id"), F.concat(F.lit("user-"), F.col("o_custkey").cast("string")).alias("entity_id"), (F.lit(LO) + k % 20 * DAY_NS).alias("valid_ns"), (F.lit(TX) + k % 9 * DAY_NS).alias("tx_ns"))
    found = temporal.as_of_join(coords, facts(spark, d))
    return found.select("coord_id", "entity_id", "valid_ns", "tx_ns", F.coalesce("system_time_ns", F.lit(-1)).alias("system_time_ns"), "dot_node_id", F.coalesce("dot_counter", F.lit(-1)).alias("dot_counter"))


@query(
    PLAIN
    + f""", win AS (SELECT o_orderkey AS window_id, 'user-' || CAST(o_custkey AS VARCHAR) AS entity_id, {LO} + (o_orderkey % 20) * {DAY_NS} AS lo, {LO} + (o_orderkey % 20 + o_orderkey % 4 - 1) * {DAY_NS} AS hi, {TX} + (o_orderkey % 9) * {DAY_NS} AS tx_ns FROM orders)
SELECT window_id, f.entity_id, f.system_time_ns, f.valid_time_start_ns, f.valid_time_end_ns, f.dot_node_id, f.dot_counter FROM win w JOIN facts f ON w.entity_id = f.entity_id AND hi > lo AND f.system_time_ns <= w.tx_ns AND f.valid_time_start_ns < w.hi AND f.valid_time_end_ns > w.lo"""
)
def range_join(spark, d):
    k = F.col("o_orderkey")
    lo = F.lit(LO) + k % 20 * DAY_NS
    windows = table(spark, d, "orders").select(k.alias("window_id"), F.concat(F.lit("user-"), F.col("o_custkey").cast("string")).alias("entity_id"), lo.alias("lo"), (lo + (k % 4 - 1) * DAY_NS).alias("hi"), (F.lit(TX) + k % 9 * DAY_NS).alias("tx_ns"))
    return temporal.range_join(windows, facts(spark, d)).select("window_id", "entity_id", "system_time_ns", "valid_time_start_ns", "valid_time_end_ns", "dot_node_id", "dot_counter")


_WINDOW = f"system_time_ns <= {TX} AND valid_time_start_ns < {HI} AND valid_time_end_ns > {LO}"


@query(PLAIN + f"SELECT {_ROW} FROM facts WHERE {_WINDOW}")
def range_window(spark, d):
    return temporal.range_window(facts(spark, d), LO, HI, TX).select(*ROW)


@query(
    PLAIN
    + f""", w AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY valid_time_start_ns, {_ORDER}) AS place, count(*) OVER (PARTITION BY entity_id) AS n FROM facts WHERE {_WINDOW})
SELECT {_ROW}, CAST(place AS BIGINT) AS place, n > 16 AS truncated FROM w WHERE place <= 16"""
)
def range_capped(spark, d):
    return temporal.range_top(facts(spark, d), LO, HI, TX, 16).select(*ROW, F.col("place").cast("long").alias("place"), "truncated")


def _coalesce_sql(base: str) -> str:
    return base + f"SELECT {_ROW} FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, valid_time_start_ns ORDER BY {_ORDER}) AS r FROM facts WHERE {_WINDOW}) WHERE r = 1"


@query(_coalesce_sql(PLAIN))
def coalesce_range(spark, d):
    return temporal.coalesce_range(temporal.range_window(facts(spark, d), LO, HI, TX)).select(*ROW)


@query(_coalesce_sql(TIED))
def coalesce_range_tied(spark, d):
    return temporal.coalesce_range(temporal.range_window(facts(spark, d, tied=True), LO, HI, TX)).select(*ROW)


@query(
    PLAIN
    + f""", v AS (SELECT * FROM facts WHERE system_time_ns <= {TX} AND system_time_ns > 0 AND valid_time_end_ns > valid_time_start_ns),
edge AS (SELECT DISTINCT entity_id, at_ns FROM (SELECT entity_id, valid_time_start_ns AS at_ns FROM v UNION ALL SELECT entity_id, valid_time_end_ns FROM v)),
s AS (SELECT * FROM (SELECT *, lead(at_ns) OVER (PARTITION BY entity_id ORDER BY at_ns) AS until_ns FROM edge) WHERE until_ns IS NOT NULL),
won AS (SELECT * FROM (SELECT s.at_ns, s.until_ns, v.*, row_number() OVER (PARTITION BY s.entity_id, s.at_ns ORDER BY v.system_time_ns DESC, tier_rank, valid_time_start_ns, assertion_time_ns, dot_node_id, dot_counter) AS r FROM s JOIN v ON s.entity_id = v.entity_id AND valid_time_start_ns <= at_ns AND valid_time_end_ns > at_ns) WHERE r = 1),
i AS (SELECT *, CASE WHEN lag(until_ns) OVER w = at_ns AND lag(dot_counter) OVER w = dot_counter AND lag(dot_node_id) OVER w = dot_node_id THEN 0 ELSE 1 END AS fresh FROM won WINDOW w AS (PARTITION BY entity_id ORDER BY at_ns)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY entity_id ORDER BY at_ns) AS island FROM i)
SELECT entity_id, dot_node_id, dot_counter, min(at_ns) AS from_ns, max(until_ns) AS to_ns FROM g GROUP BY entity_id, island, dot_node_id, dot_counter"""
)
def timeline(spark, d):
    return temporal.timeline(facts(spark, d), TX)


@query(
    PLAIN
    + f""", w AS (SELECT * FROM facts WHERE {_WINDOW}), k AS (SELECT * FROM w WHERE tier_rank <> 2),
l AS (SELECT *, row_number() OVER (PARTITION BY entity_id, system_time_ns, payload_digest ORDER BY {_ORDER}) AS r FROM w WHERE tier_rank = 2 AND (entity_id, system_time_ns, payload_digest) NOT IN (SELECT entity_id, system_time_ns, payload_digest FROM k))
SELECT {_ROW} FROM k UNION ALL SELECT {_ROW} FROM l WHERE r = 1"""
)
def live_merge_range(spark, d):
    return temporal.live_merge_range(facts(spark, d), LO, HI, TX).select(*ROW)


@query(ORACLE_SQL["live_merge_range"].replace(PLAIN, TIED))
def live_merge_range_tied(spark, d):
    return temporal.live_merge_range(facts(spark, d, tied=True), LO, HI, TX).select(*ROW)


@query(PLAIN + f"SELECT {_ROW}, CAST(NULL AS VARCHAR) AS payload FROM facts WHERE tier_rank = 2 AND system_time_ns <= {TX}")
def live_read(spark, d):
    return temporal.live_read(facts(spark, d).where(F.col("tier_rank") == LIVE), TX).select(*ROW, "payload")


@query(ORACLE_SQL["live_merge_range_tied"])
def live_source_range(spark, d):
    """The merge with the live rows as a source of their own."""
    rows = facts(spark, d, tied=True)
    both = temporal.with_live(rows.where(F.col("tier_rank") != LIVE), rows.where(F.col("tier_rank") == LIVE).drop("tier_rank"))
    return temporal.live_merge_range(both, LO, HI, TX).select(*ROW)


@query(_as_of_sql(TIED).replace("FROM facts WHERE", "FROM facts WHERE tier_rank >= 1 AND"))
def live_merge_as_of(spark, d):
    return temporal.live_merge_as_of(facts(spark, d, tied=True).where("tier_rank >= 1"), V, TX).select(*ROW)


@query(PLAIN + f"SELECT {_ROW} FROM facts WHERE entity_id = 'user-7'")
def point_get(spark, d):
    return temporal.of_entity(facts(spark, d), "user-7").select(*ROW)


_LATEST = "SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY dot_counter DESC, dot_node_id) AS r FROM facts"
_CKPT = "SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY dot_node_id DESC, dot_counter DESC) AS r FROM facts"


@query(PLAIN + f"SELECT {_ROW} FROM ({_LATEST}) WHERE r = 1")
def latest_dot(spark, d):
    return temporal.latest_dot(facts(spark, d)).select(*ROW)


@query(PLAIN + f"SELECT {_ROW} FROM ({_CKPT}) WHERE r = 1")
def checkpoint_latest(spark, d):
    return temporal.checkpoint_latest(facts(spark, d)).select(*ROW)


@query(PLAIN + f"SELECT entity_id, dot_node_id, dot_counter, CASE WHEN tier_rank = 2 THEN payload END AS payload FROM ({_LATEST}) WHERE r = 1")
def payload_for_dot(spark, d):
    rows = facts(spark, d)
    return temporal.with_payload(temporal.latest_dot(rows), rows.where(F.col("tier_rank") == LIVE)).select("entity_id", "dot_node_id", "dot_counter", "payload")


@query(PLAIN + f", a AS ({_CKPT}), b AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY dot_node_id DESC, dot_counter DESC) AS r FROM facts WHERE system_time_ns <= {TX}) SELECT a.entity_id, a.dot_node_id, a.dot_counter FROM a WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM b WHERE b.r = 1 AND b.entity_id = a.entity_id AND b.dot_node_id = a.dot_node_id AND b.dot_counter = a.dot_counter)")
def query_tier_delta(spark, d):
    rows = facts(spark, d)
    return maintenance.changed_since(temporal.checkpoint_latest(rows), temporal.checkpoint_latest(temporal.visible(rows, TX))).select("entity_id", "dot_node_id", "dot_counter")


@query("SELECT max(epoch_us(ts)) * 1000 AS tx_frontier_ns FROM events")
def tx_frontier(spark, d):
    return facts(spark, d).agg(F.max("system_time_ns").alias("tx_frontier_ns"))


# ---- the replicated set: node a holds two thirds of the dots, node b another two thirds

_SPLIT = PLAIN + ", a AS (SELECT * FROM facts WHERE seq % 3 <> 0), b AS (SELECT * FROM facts WHERE seq % 3 <> 1)"


def _two(spark, d):
    rows = state(spark, d)
    return rows.where("seq % 3 <> 0"), rows.where("seq % 3 <> 1")


@query(_SPLIT + f" SELECT DISTINCT {_ROW} FROM (SELECT * FROM a UNION ALL SELECT * FROM b)")
def crdt_join(spark, d):
    return replica.join(*_two(spark, d)).select(*ROW)


@query(_SPLIT + " SELECT (SELECT count(*) FROM b) * 2 AS received, count(*) AS inserted, (SELECT count(*) FROM b) * 2 - count(*) AS skipped FROM b WHERE seq NOT IN (SELECT seq FROM a)")
def crdt_join_stats(spark, d):
    a, b = _two(spark, d)
    return replica.join_stats(a, b.unionByName(b))


@query(_SPLIT + f" SELECT {_ROW} FROM a WHERE seq NOT IN (SELECT seq FROM b)")
def crdt_delta(spark, d):
    return replica.difference(*_two(spark, d)).select(*ROW)


@query(PLAIN + f"SELECT {_ROW} FROM facts")
def crdt_dedupe(spark, d):
    rows = facts(spark, d)
    return replica.dedupe(rows.unionByName(rows)).select(*ROW)


_DOT = "dot_node_id || lower(lpad(to_hex(dot_counter), 16, '0'))"
_LEVELS = ", ".join(
    f"l{k} AS (SELECT dot_node_id, at_k // 1024 AS at_k, sha256(from_hex(string_agg(dg, '' ORDER BY at_k))) AS dg, CAST(sum(n) AS BIGINT) AS n FROM l{k - 1} GROUP BY 1, at_k // 1024)" for k in range(1, 7)
)
_TREE = f"l0 AS (SELECT dot_node_id, dot_counter // 1024 AS at_k, sha256(from_hex(string_agg({_DOT}, '' ORDER BY dot_counter))) AS dg, count(*) AS n FROM (SELECT DISTINCT dot_node_id, dot_counter FROM %T%) GROUP BY 1, 2), {_LEVELS}, root AS (SELECT sha256(from_hex(string_agg(dg, '' ORDER BY dot_node_id))) AS root, CAST(sum(n) AS BIGINT) AS n FROM l6)"


@query(PLAIN + ", " + _TREE.replace("%T%", "facts") + " SELECT root, n FROM root")
def merkle_root(spark, d):
    return replica.tree_root(facts(spark, d))


_BY = "entity_id, dot_node_id"
_BY_LEVELS = ", ".join(f"l{k} AS (SELECT {_BY}, at_k // 1024 AS at_k, sha256(from_hex(string_agg(dg, '' ORDER BY at_k))) AS dg, CAST(sum(n) AS BIGINT) AS n FROM l{k - 1} GROUP BY {_BY}, at_k // 1024)" for k in range(1, 7))


@query(PLAIN + f", l0 AS (SELECT {_BY}, dot_counter // 1024 AS at_k, sha256(from_hex(string_agg({_DOT}, '' ORDER BY dot_counter))) AS dg, count(*) AS n FROM (SELECT DISTINCT {_BY}, dot_counter FROM facts) GROUP BY 1, 2, 3), {_BY_LEVELS} SELECT entity_id, sha256(from_hex(string_agg(dg, '' ORDER BY dot_node_id))) AS root, CAST(sum(n) AS BIGINT) AS n FROM l6 GROUP BY entity_id")
def merkle_root_by_entity(spark, d):
    return replica.tree_root(facts(spark, d), ("entity_id",))


_BE = "lpad(to_hex({}), 16, '0')"
_ENTRY = "upper(payload_digest || dot_node_id || dot_node_id || " + " || ".join(_BE.format(c) for c in ("dot_counter", "system_time_ns", "valid_time_start_ns", "valid_time_end_ns", "assertion_time_ns")) + ")"
_FINGER = f"sha256(encode('chronoset/state/v1') || encode(entity_id) || from_hex('00') || from_hex({_ENTRY}))"


@query(
    PLAIN
    + f""", r AS (SELECT {_FINGER} AS d FROM facts),
g6 AS (SELECT d[1:6] AS k, sha256(string_agg(d, '' ORDER BY d)) AS d, count(*) AS n FROM r GROUP BY 1),
g4 AS (SELECT k[1:4] AS k, sha256(string_agg(k || d, '' ORDER BY k || d)) AS d, sum(n) AS n FROM g6 GROUP BY k[1:4]),
g2 AS (SELECT k[1:2] AS k, sha256(string_agg(k || d, '' ORDER BY k || d)) AS d, sum(n) AS n FROM g4 GROUP BY k[1:2])
SELECT sha256(string_agg(k || d, '' ORDER BY k || d)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n FROM g2"""
)
def state_fingerprint(spark, d):
    return replica.state_fingerprint(state(spark, d))


@query(PLAIN + f"SELECT count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities, max(dot_counter) AS lamport_high, max(dot_counter) FILTER (WHERE dot_node_id = '{NODE}') AS own_high FROM facts")
def state_capture(spark, d):
    return replica.capture(facts(spark, d), NODE)


@query("SELECT event_id, lpad('7', 32, '0') AS dot_node_id, 1000000 + row_number() OVER (ORDER BY ts, event_id) AS dot_counter FROM events")
def next_dots(spark, d):
    return replica.assign_dots(table(spark, d, "events"), "7".rjust(32, "0"), 1_000_000, ["ts", "event_id"]).select("event_id", "dot_node_id", "dot_counter")


_CLOCK = "SELECT event_id, c, greatest(0, coalesce(max(c) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS before FROM (SELECT event_id, (event_id * 7919) % 10007 + event_id AS c FROM events)"


@query(f"SELECT event_id, greatest(before, c) AS lamport, greatest(c - before, 0) AS jump FROM ({_CLOCK})")
def lamport_clock(spark, d):
    log = table(spark, d, "events").select("event_id", (F.col("event_id") * 7919 % 10007 + F.col("event_id")).alias("dot_counter"))
    return replica.lamport_clock(log, ["event_id"]).select("event_id", "lamport", "jump")


@query(_SPLIT + ", " + _TREE.replace("%T%", "a").replace("root AS", "ra AS") + " SELECT count(*) AS n_nodes, count(DISTINCT root) AS n_roots, count(DISTINCT root) = 1 AS converged FROM (SELECT root FROM ra UNION ALL SELECT root FROM ra)")
def roots_converged(spark, d):
    a, _ = _two(spark, d)
    root = replica.tree_root(a).select("root")
    return convergence.all_equal(root.unionByName(root))


# ---- sketches: hashes and cells by arithmetic in SQL; the peeled result equals the exact difference


def _keys(rows: DataFrame) -> DataFrame:
    return rows.select(sketch.hash_dot("dot_node_id", "dot_counter", "payload_digest").alias("key"))


#: FNV-1a over a dot's node, little-endian counter and digest; XXH64 of that key, of which cells are made; both as unsigned numbers.
_HEX = "CAST(instr('0123456789abcdef', x[2 * i + 1]) * 16 + instr('0123456789abcdef', x[2 * i + 2]) - 17 AS UBIGINT)"
_M = 1 << 64
_FNV = f"""h AS (SELECT *, list_reduce([CAST({0xCBF29CE484222325} AS UBIGINT)] || list_transform(range(0, 56), lambda i: {_HEX}),
  lambda h, b: CAST((CAST(xor(h, b) AS UHUGEINT) * {0x100000001B3}) % {_M} AS UBIGINT)) AS u
  FROM (SELECT seq, dot_node_id || array_to_string(list_reverse(regexp_extract_all(lpad(lower(to_hex(dot_counter)), 16, '0'), '..')), '') || payload_digest AS x FROM facts)),
keys AS (SELECT *, CAST(CASE WHEN u >= {1 << 63} THEN CAST(u AS HUGEINT) - {_M} ELSE u END AS BIGINT) AS key FROM h)"""


def _times(value: str, factor: int) -> str:
    return f"CAST((CAST({value} AS UHUGEINT) * {factor}) % {_M} AS UBIGINT)"


def _rotated(value: str, n: int) -> str:
    return f"(CAST((CAST({value} AS UHUGEINT) * {1 << n}) % {_M} AS UBIGINT) + ({value}) // {1 << 64 - n})"


_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_XXH = f"""x1 AS (SELECT *, {_times("u", _P2)} AS a FROM keys), x2 AS (SELECT *, {_times(_rotated("a", 31), _P1)} AS b FROM x1), x3 AS (SELECT *, xor(b, CAST({(42 + _P5 + 8) % _M} AS UBIGINT)) AS c FROM x2),
x4 AS (SELECT *, CAST((CAST({_times(_rotated("c", 27), _P1)} AS UHUGEINT) + {_P4}) % {_M} AS UBIGINT) AS e FROM x3), x5 AS (SELECT *, {_times("xor(e, e >> 33)", _P2)} AS f FROM x4), x6 AS (SELECT *, {_times("xor(f, f >> 29)", _P3)} AS g FROM x5),
hashed AS (SELECT *, xor(g, g >> 32) AS w, CAST(CASE WHEN xor(g, g >> 32) >= {1 << 63} THEN CAST(xor(g, g >> 32) AS HUGEINT) - {_M} ELSE xor(g, g >> 32) END AS BIGINT) AS hash FROM x6)"""


def _iblt_sql(cells: int, hashes: int, by: str = "") -> str:
    return PLAIN + f", {_FNV}, {_XXH}, cell AS (SELECT *, CAST((w % {cells} + i * (((w >> 32) | 1) % {cells})) % {cells} AS INTEGER) AS cell FROM hashed, range({hashes}) AS r(i)) SELECT {by}cell, count(*) AS n, bit_xor(key) AS key_xor, bit_xor(hash) AS hash_xor FROM cell GROUP BY ALL"


@query(PLAIN + f", {_FNV} SELECT seq, key FROM keys")
def hash_dot(spark, d):
    return facts(spark, d).select("seq", sketch.hash_dot("dot_node_id", "dot_counter", "payload_digest").alias("key"))


@query(_iblt_sql(sketch.CELLS, sketch.HASHES))
def iblt_build(spark, d):
    return sketch.iblt(_keys(facts(spark, d)))


_ALONE = _SPLIT + " SELECT {} FROM a WHERE seq NOT IN (SELECT seq FROM b)"


@query(_ALONE.format("seq, CAST(1 AS BIGINT) AS side") + " UNION ALL SELECT seq, CAST(-1 AS BIGINT) FROM b WHERE seq NOT IN (SELECT seq FROM a)")
def iblt_difference(spark, d):
    rows = facts(spark, d).withColumn("key", sketch.hash_dot("dot_node_id", "dot_counter", "payload_digest"))
    found = sketch.difference(rows.where("seq % 3 <> 0").select("key"), rows.where("seq % 3 <> 1").select("key"))
    return rows.join(found, "key").select("seq", "side")


@query()
def strata_estimate(spark, d):
    rows = facts(spark, d)
    return sketch.estimate(sketch.strata(_keys(rows.where("seq % 100 <> 1"))), sketch.strata(_keys(rows.where("seq % 100 <> 0"))))


@query(_iblt_sql(sketch.STRATUM_CELLS, sketch.STRATUM_HASHES, "CAST(CASE WHEN u % 2147483648 = 0 THEN 31 ELSE bit_count(xor(u % 2147483648, u % 2147483648 - 1)) - 1 END AS INTEGER) AS stratum, "))
def strata_build(spark, d):
    return sketch.strata(_keys(facts(spark, d)))


# ---- maintenance


def _prune_sql(base: str) -> str:
    return base + f"SELECT {_ROW} FROM facts r WHERE NOT EXISTS (SELECT 1 FROM facts t WHERE t.entity_id = r.entity_id AND t.system_time_ns > r.system_time_ns AND t.valid_time_start_ns <= r.valid_time_start_ns AND t.valid_time_end_ns >= r.valid_time_end_ns AND t.system_time_ns <= {TX})"


@query(_prune_sql(PLAIN))
def dominance_prune(spark, d):
    return maintenance.dominance_prune(facts(spark, d), TX).select(*ROW)


@query(_prune_sql(TIED))
def dominance_prune_tied(spark, d):
    return maintenance.dominance_prune(facts(spark, d, tied=True), TX).select(*ROW)


@query("SELECT event_id, h AS horizon_ns, coalesce(h < before, false) AS refused, greatest(h, before) AS effective FROM (SELECT *, max(h) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT event_id, epoch_us(ts) * 1000 - (event_id * 31 % 97) * 3600000000000 AS h FROM events))")
def horizon_monotone(spark, d):
    log = facts(spark, d).select(F.col("seq").alias("event_id"), (F.col("system_time_ns") - F.col("seq") * 31 % 97 * 3600000000000).alias("horizon_ns"))
    return maintenance.horizon_log(log, ["event_id"]).select("event_id", "horizon_ns", "refused", "effective")


@query("SELECT greatest(1705300000000000000, max(epoch_us(ts)) * 1000 - 3600000000000) AS horizon_ns FROM events")
def effective_horizon(spark, d):
    top = facts(spark, d).agg(F.max("system_time_ns").alias("t"))
    return top.select(F.greatest(F.lit(1705300000000000000), F.col("t") - 3600000000000).alias("horizon_ns"))


_FILES = "files AS (SELECT sha256(entity_id)[1:16] AS hash8, 'l0/' || sha256(entity_id)[1:16] || '/' || CAST(min(system_time_ns) AS VARCHAR) || '.arrow' AS key, min(system_time_ns) AS first_sys, count(*) AS n_rows, min(seq) % 10 <> 0 AS readable FROM facts GROUP BY entity_id, seq // 100)"


def _files(spark, d):
    rows = facts(spark, d).withColumn("hash8", layout.entity_hash8())
    one = rows.groupBy("entity_id", F.expr("seq div 100").alias("flush")).agg(F.min("hash8").alias("hash8"), F.min("system_time_ns").alias("first_sys"), F.count("*").alias("n_rows"), (F.min("seq") % 10 != 0).alias("readable"))
    return one.select("hash8", F.concat(F.lit("l0/"), "hash8", F.lit("/"), F.col("first_sys").cast("string"), F.lit(".arrow")).alias("key"), "first_sys", "n_rows", "readable")


@query(PLAIN + ", " + _FILES + " SELECT hash8, count(*) AS n FROM files GROUP BY hash8 HAVING count(*) >= 40")
def compaction_candidates(spark, d):
    return maintenance.compaction_candidates(_files(spark, d), 40)


@query(PLAIN + ", " + _FILES + " SELECT 'l1/' || hash8 || '/' || CAST(min(first_sys) OVER (PARTITION BY hash8) AS VARCHAR) || '.arrow' AS l1_key, key AS l0_key FROM files WHERE readable")
def compaction_manifest(spark, d):
    return maintenance.compaction_manifest(_files(spark, d))


@query(PLAIN + f"SELECT {_ROW}, 0 AS tier_rank FROM facts r WHERE tier_rank = 1 AND NOT EXISTS (SELECT 1 FROM facts t WHERE t.tier_rank = 1 AND t.entity_id = r.entity_id AND t.system_time_ns > r.system_time_ns AND t.valid_time_start_ns <= r.valid_time_start_ns AND t.valid_time_end_ns >= r.valid_time_end_ns AND t.system_time_ns <= {TX})")
def compaction_merge(spark, d):
    return maintenance.compact(facts(spark, d).where("tier_rank = 1"), TX).select(*ROW, "tier_rank")


_MAN = "man AS (SELECT 'm-' || hash8 AS name, 'l1/' || hash8 || '/0.arrow' AS l1_key, key AS l0_key FROM files WHERE readable)"


def _manifests(spark, d):
    files = _files(spark, d).where("readable")
    text = F.concat(F.lit("\n  l1/"), "hash8", F.lit("/0.arrow\n"), F.array_join(F.sort_array(F.collect_list("key")), "\n"), F.lit("\nnot a key\n"))
    return layout.parse_manifests(files.groupBy("hash8").agg(text.alias("content")).select(F.concat(F.lit("m-"), "hash8").alias("name"), "content"))


@query(PLAIN + ", " + _FILES + ", " + _MAN + " SELECT * FROM man")
def manifest_parse(spark, d):
    return _manifests(spark, d)


@query(PLAIN + ", " + _FILES + " SELECT key FROM files WHERE NOT readable")
def supersession(spark, d):
    return layout.surviving_l0(_files(spark, d).select("key"), _manifests(spark, d))


@query(PLAIN + ", " + _FILES + f" SELECT key FROM files WHERE first_sys <= {TX}")
def first_sys_skip(spark, d):
    return layout.visible_files(_files(spark, d), TX).select("key")


@query(PLAIN + ", " + _FILES + " SELECT key, (SELECT count(*) FROM files) > 1000 AS capped FROM files ORDER BY first_sys DESC, key DESC LIMIT 1000")
def l0_tail_cap(spark, d):
    return layout.newest_files(_files(spark, d)).select("key", "capped")


@query(
    PLAIN
    + ", "
    + _FILES
    + ", "
    + _MAN
    + ", l1 AS (SELECT l1_key, min(l0_key) AS k, count(*) AS n FROM man GROUP BY 1) SELECT m.name, m.l1_key, count(*) AS n_l0, CASE WHEN ascii(m.l1_key[5:5]) % 3 = 0 THEN 'skip_orphan' WHEN ascii(m.l1_key[5:5]) % 3 = 1 THEN 'skip_error' ELSE 'reap' END AS action FROM man m GROUP BY 1, 2"
)
def reap_plan(spark, d):
    man = _manifests(spark, d)
    kind = F.ascii(F.substring("key", 5, 1)) % 3
    l1 = man.select(F.col("l1_key").alias("key")).distinct().where(kind != 0).select("key", (kind == 2).alias("readable"))
    return maintenance.reap_plan(man, l1)


_PEERS = "peers AS (SELECT 'node-' || CAST(c_nationkey AS VARCHAR) AS node_id, c_custkey % 40 AS epoch FROM customer), st AS (SELECT coalesce(min(e), 0) AS stable_epoch FROM (SELECT max(epoch) AS e FROM peers GROUP BY node_id)), tomb AS (SELECT DISTINCT 'user-' || CAST(c_custkey AS VARCHAR) AS entity_id, c_custkey % 60 AS epoch FROM customer)"


def _peers(spark, d):
    c = table(spark, d, "customer")
    peers = c.select(F.concat(F.lit("node-"), F.col("c_nationkey").cast("string")).alias("node_id"), (F.col("c_custkey") % 40).alias("epoch"))
    tombs = c.select(F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("entity_id"), (F.col("c_custkey") % 60).alias("epoch")).distinct()
    return peers, tombs


@query("WITH " + _PEERS + " SELECT * FROM st")
def stable_epoch(spark, d):
    return maintenance.stable_epoch(_peers(spark, d)[0])


@query(PLAIN + ", " + _PEERS + f" SELECT {_ROW} FROM facts WHERE entity_id NOT IN (SELECT entity_id FROM tomb, st WHERE stable_epoch >= 2 AND epoch <= stable_epoch - 2)")
def tombstone_prune(spark, d):
    peers, tombs = _peers(spark, d)
    return maintenance.drop_tombstoned(facts(spark, d), maintenance.prunable_tombstones(tombs, peers)).select(*ROW)


# ---- ingest


@query(
    f"""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE epoch_us(o_orderdate) * 1000 END AS f, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 9223372036854775807 ELSE o_orderkey * {DAY_NS} END AS n FROM orders),
s AS (SELECT *, coalesce(f, {TX}) AS vs FROM r)
SELECT o_orderkey, vs AS valid_time_start_ns, CAST(CASE WHEN n IS NULL OR n <= 0 OR vs >= {OPEN_END} OR CAST(n AS HUGEINT) + greatest(vs, 0) > {OPEN_END} THEN {OPEN_END} ELSE vs + n END AS BIGINT) AS valid_time_end_ns FROM s"""
)
def open_end_clamp(spark, d):
    k = F.col("o_orderkey")
    # a span past 64 bits is past the open end from any start, or negative: it is open, as null is; try_multiply would throw and catch for each
    days = ((1 << 63) - 1) // DAY_NS
    span = F.when(k % 5 == 0, None).when(k % 5 == 1, 0).when(k % 5 == 2, (1 << 63) - 1).when(k.between(-days, days), k * DAY_NS)
    start = F.when(k % 4 == 0, None).otherwise(src.micros("o_orderdate") * 1000)
    requests = table(spark, d, "orders").select(k, start.alias("valid_from_ns"), span.alias("valid_for_ns"), F.lit("v").alias("val"))
    return src.stamp_inserts(requests, F.lit(TX)).select("o_orderkey", "valid_time_start_ns", "valid_time_end_ns")


_FRAMES = PLAIN + (
    ", frames AS (SELECT *, CASE WHEN seq % 41 = 0 THEN 'short' WHEN seq % 43 = 0 THEN lpad('9', 32, '0') ELSE dot_node_id END AS origin_node_id,"
    " CASE WHEN seq % 47 = 0 THEN payload || 'x' ELSE payload END AS body, CASE WHEN seq % 53 = 0 THEN 0 ELSE dot_counter END AS c FROM facts),"
    " checked AS (SELECT *, CASE WHEN length(origin_node_id) <> 32 THEN 'bad_origin' WHEN dot_node_id <> origin_node_id THEN 'origin_mismatch' WHEN c <= 0 THEN 'zero_dot' WHEN sha256(body) <> payload_digest THEN 'digest_mismatch' END AS error_kind FROM frames)"
)


def _frames(spark, d):
    n = F.col("seq")
    rows = facts(spark, d)
    origin = F.when(n % 41 == 0, "short").when(n % 43 == 0, "9".rjust(32, "0")).otherwise(F.col("dot_node_id"))
    return rows.withColumns({"origin_node_id": origin, "payload": F.when(n % 47 == 0, F.concat("payload", F.lit("x"))).otherwise(F.col("payload")), "dot_counter": F.when(n % 53 == 0, 0).otherwise(F.col("dot_counter"))})


@query(_FRAMES + " SELECT seq, error_kind FROM checked")
def integrity_check(spark, d):
    return _frames(spark, d).select("seq", admission.error_kind().alias("error_kind"))


_VERDICT = "CASE WHEN error_kind IS NOT NULL THEN 'drop_malformed' WHEN NOT (seq % 3 = 0 OR c < 8000) THEN 'drop_rate' WHEN NOT ((seq % 7) * 500 <= 2000) THEN 'drop_clock' WHEN seq % 59 = 0 THEN 'drop_depth' WHEN seq % 61 = 0 THEN 'drop_verify' ELSE 'accept' END"


def _verdicts(spark, d):
    n = F.col("seq")
    rate = (n % 3 == 0) | admission.rate_ok(F.col("dot_counter"), 8000)
    clock = admission.clock_ok(n * 10 + n % 7 * 500, n * 10)
    return _frames(spark, d).select("seq", "dot_node_id", "system_time_ns", admission.verdict(admission.error_kind().isNull(), rate, clock, n % 59 != 0, n % 61 != 0).alias("verdict"))


@query(_FRAMES + f" SELECT seq, {_VERDICT} AS verdict FROM checked")
def verdict_chain(spark, d):
    return _verdicts(spark, d).select("seq", "verdict")


@query(_FRAMES + f" SELECT dot_node_id, {_VERDICT} AS verdict, count(*) AS n FROM checked GROUP BY ALL")
def verdict_counts(spark, d):
    return _verdicts(spark, d).groupBy("dot_node_id", "verdict").agg(F.count("*").alias("n"))


@query("SELECT event_id, (event_id % 9 - 4) * 1000 <= 2000 AS admitted FROM events")
def clock_cap(spark, d):
    n = F.col("event_id")
    return table(spark, d, "events").select("event_id", admission.clock_ok(n + (n % 9 - 4) * 1000, n).alias("admitted"))


_GATE = "SELECT seq, entity_id, c, CASE WHEN c < 8000 THEN c END AS okc FROM (SELECT seq, entity_id, (seq * 7919) % 10007 + 1 AS c FROM facts)"


@query(
    PLAIN
    + f""", g AS ({_GATE}), l AS (SELECT *, coalesce(max(okc) OVER (PARTITION BY entity_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last_c FROM g)
SELECT seq, CASE WHEN c <= last_c OR c < 8000 THEN 'keep' ELSE 'drop' END AS verdict, greatest(c - last_c, 0) AS delta, 8000 - CASE WHEN c < 8000 THEN greatest(last_c, c) ELSE last_c END AS remaining FROM l"""
)
def rate_gate(spark, d):
    frames = facts(spark, d).select("seq", "entity_id", (F.col("seq") * 7919 % 10007 + 1).alias("dot_counter"))
    return admission.rate_gate(frames, ["entity_id"], ["seq"], budget=8000).select("seq", "verdict", "delta", "remaining")


def _rate_sql(base: str, value: str, keep: float, terms: int, over: str) -> str:
    # exact decimals may end in 5 at the seventh place: 1e-9 rounds them alike in both engines
    return base + "SELECT seq, round(" + " + ".join(f"{(1 - keep) * keep**k!r} * coalesce(lag({value}, {k}) OVER w, 0)" for k in range(terms)) + f" + 1e-9, 6) AS rate FROM {over}"


@query(_rate_sql(PLAIN + f", g AS ({_GATE}), l AS (SELECT *, coalesce(max(okc) OVER (PARTITION BY entity_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last_c FROM g), m AS (SELECT *, c - last_c AS delta FROM l WHERE c > last_c) ", "delta", 0.1, 20, "m WINDOW w AS (PARTITION BY entity_id ORDER BY seq)"))
def moving_rate(spark, d):
    frames = facts(spark, d).select("seq", "entity_id", (F.col("seq") * 7919 % 10007 + 1).alias("dot_counter"))
    gated = admission.rate_gate(frames, ["entity_id"], ["seq"], budget=8000)
    return admission.moving_rate(gated, ["entity_id"], ["seq"]).select("seq", F.round(F.col("rate") + 1e-9, 6).alias("rate"))


@query(_rate_sql(f"WITH l AS (SELECT event_id AS seq, c - before AS jump FROM ({_CLOCK}) WHERE c > before) ", "jump", 0.9, 400, "l WINDOW w AS (ORDER BY seq)"))
def inbound_rate(spark, d):
    log = table(spark, d, "events").select(F.col("event_id").alias("seq"), (F.col("event_id") * 7919 % 10007 + F.col("event_id")).alias("dot_counter"))
    return replica.inbound_rate(replica.lamport_clock(log, ["seq"]), ["seq"]).select("seq", F.round(F.col("rate") + 1e-9, 6).alias("rate"))


@query("SELECT event_id, CAST(event_id + ceil(value / 10 * 60) + 1000 AS BIGINT) AS bound FROM events")
def skew_bound(spark, d):
    return table(spark, d, "events").select("event_id", admission.skew_bound(F.col("event_id"), F.col("value") / 10).alias("bound"))


@query(_FRAMES + " SELECT dot_node_id, seq // 32 AS batch, count(*) AS n, min(error_kind) AS error_kind, bool_and(error_kind IS NULL) AS applied FROM checked GROUP BY ALL")
def batch_all_or_nothing(spark, d):
    return admission.batch_verdicts(_frames(spark, d).withColumn("batch", F.expr("seq div 32")), ["dot_node_id", "batch"])


@query(
    _FRAMES
    + """, b AS (SELECT dot_node_id, seq // 32 AS batch, bool_and(error_kind IS NULL) AS p, bool_and(c < 9000) AS r, bool_and(origin_node_id IN ('00000000000000000000000000000000', '00000000000000000000000000000001', '00000000000000000000000000000003')) AS k, bool_and(seq % 331 <> 0) AS s, count(*) AS n FROM checked GROUP BY 1, 2)
SELECT dot_node_id, batch, CASE WHEN NOT p THEN 'drop_malformed' WHEN NOT r THEN 'drop_rate' WHEN NOT k THEN 'drop_unknown_origin' WHEN NOT s THEN 'drop_verify' ELSE 'accept' END AS verdict, n FROM b"""
)
def batch_gate(spark, d):
    frames = _frames(spark, d).withColumn("batch", F.expr("seq div 32"))
    directory = facts(spark, d).where("seq % 4 <> 2").select(F.col("dot_node_id").alias("origin_node_id"))
    return admission.batch_gate(frames, ["dot_node_id", "batch"], directory, F.col("seq") % 331 != 0, 9000)


@query(_FRAMES + " SELECT DISTINCT seq // 32 AS batch, origin_node_id, c AS dot_counter FROM checked")
def inspect_batch_dots(spark, d):
    return admission.inspect_dots(_frames(spark, d).withColumn("batch", F.expr("seq div 32")), ["batch"])


@query(PLAIN + "SELECT dot_node_id, (r - 1) // 256 AS chunk, count(*) AS n, min(dot_counter) AS first, max(dot_counter) AS last FROM (SELECT *, row_number() OVER (PARTITION BY dot_node_id ORDER BY dot_counter) AS r FROM facts) GROUP BY ALL")
def batch_chunks(spark, d):
    ranked = rank_in_key(facts(spark, d), ["dot_node_id"], ["dot_counter"])
    return ranked.groupBy("dot_node_id", F.expr("(rank - 1) div 256").alias("chunk")).agg(F.count("*").alias("n"), F.min("dot_counter").alias("first"), F.max("dot_counter").alias("last"))


@query("SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 400 WHEN event_id % 19 = 0 THEN 503 ELSE 200 END AS status FROM events")
def insert_status(spark, d):
    n = F.col("event_id")
    results = table(spark, d, "events").select("event_id", F.when(n % 17 != 0, F.col("event_type")).alias("key"), (n % 19 != 0).alias("logged"))
    return admission.insert_status(results).select("event_id", "status")


# ---- recovery: a log of every event, with an advance or a checkpoint now and then

_LOG = PLAIN + (
    f", log AS (SELECT seq, CASE seq % 64 WHEN 63 THEN 'checkpoint' WHEN 25 THEN 'clock_advance' ELSE 'mutation' END AS type, entity_id, '{NODE}' AS dot_node_id, dot_counter, seq * 2 AS advance, seq AS lamport_high, CASE WHEN seq % 128 = 63 THEN seq - 10 END AS cut_seq FROM facts),"
    " cp AS (SELECT coalesce(cut_seq, seq + 1) AS cut FROM log WHERE type = 'checkpoint' ORDER BY seq DESC LIMIT 1), mut AS (SELECT * FROM log WHERE type = 'mutation'),"
    f" image AS (SELECT entity_id, dot_node_id, dot_counter FROM mut, cp WHERE seq < cut AND seq % 101 <> 0 UNION ALL SELECT entity_id, '{NODE}', dot_counter + 1000000000 FROM mut WHERE seq % 997 = 0)"
)


def _log(spark, d):
    n = F.col("seq")
    kind = F.when(n % 64 == 63, recovery.CHECKPOINT).when(n % 64 == 25, recovery.ADVANCE).otherwise(recovery.MUTATION)
    return facts(spark, d).select("seq", kind.alias("type"), "entity_id", F.lit(NODE).alias("dot_node_id"), "dot_counter", (n * 2).alias("advance"), n.alias("lamport_high"), F.when(n % 128 == 63, n - 10).alias("cut_seq"))


def _image(log, phantoms: bool = True):
    m = recovery.mutations(log, NODE)
    cut = F.broadcast(recovery.last_checkpoint(log).select("cut"))
    kept = m.join(cut, (F.col("seq") < F.col("cut")) & (F.col("seq") % 101 != 0)).select("entity_id", "dot_node_id", "dot_counter")
    ghosts = m.where("seq % 997 = 0").select("entity_id", "dot_node_id", (F.col("dot_counter") + 1_000_000_000).alias("dot_counter"))
    return kept.unionByName(ghosts) if phantoms else kept


@query("SELECT count(*) AS n, min(event_id) AS first, max(event_id) AS last, count(*) = 0 OR (min(event_id) = 0 AND max(event_id) = count(*) - 1 AND count(DISTINCT event_id) = count(*)) AS contiguous FROM events")
def wal_contiguity(spark, d):
    return recovery.contiguity(_log(spark, d))


@query(_LOG + " SELECT max(CASE type WHEN 'mutation' THEN dot_counter WHEN 'clock_advance' THEN advance ELSE lamport_high END) AS lamport_high, CAST(0 AS BIGINT) AS n_clamped FROM log")
def wal_lamport_high(spark, d):
    return recovery.lamport_high(_log(spark, d))


@query(_LOG + " SELECT seq, entity_id, dot_counter FROM mut, cp WHERE seq >= cut")
def wal_tail(spark, d):
    return recovery.tail(_log(spark, d), NODE).select("seq", "entity_id", "dot_counter")


@query(_LOG + " SELECT entity_id, dot_counter FROM image WHERE dot_counter NOT IN (SELECT dot_counter FROM mut)")
def recovery_phantoms(spark, d):
    log = _log(spark, d)
    return recovery.phantoms(_image(log), log, NODE).select("entity_id", "dot_counter")


@query(_LOG + " SELECT seq, entity_id, dot_counter FROM mut, cp WHERE seq < cut AND dot_counter NOT IN (SELECT dot_counter FROM image)")
def recovery_holes(spark, d):
    log = _log(spark, d)
    return recovery.holes(_image(log), log, NODE).select("seq", "entity_id", "dot_counter")


@query(_LOG + " SELECT entity_id, dot_node_id, dot_counter FROM mut")
def recovery_rebuild(spark, d):
    log = _log(spark, d)
    return recovery.rebuild(_image(log, phantoms=False), log, NODE)


# ---- peers and metrics

_PEER = "peer AS (SELECT 'peer-' || CAST(s_suppkey AS VARCHAR) AS peer_id, s_nationkey % 8 AS region FROM supplier)"


@query("WITH " + _PEER + ", f AS (SELECT region, count(*) AS n FROM peer WHERE region NOT IN (0, 3) GROUP BY 1 ORDER BY 1 LIMIT 4) SELECT region, count(*) AS n FROM peer WHERE region IN (0, 3) GROUP BY 1 UNION ALL SELECT region, 1 FROM f")
def region_fanout(spark, d):
    peers = table(spark, d, "supplier").select(F.concat(F.lit("peer-"), F.col("s_suppkey").cast("string")).alias("peer_id"), (F.col("s_nationkey") % 8).alias("region"))
    return convergence.region_fanout(peers, 3, 4).groupBy("region").agg(F.count("*").alias("n"))


@query(
    "SELECT event_type, max(v) FILTER (WHERE r = ceil(n * 0.5)) AS t50, max(v) FILTER (WHERE r = ceil(n * 0.9)) AS t90, max(v) FILTER (WHERE r = n) AS t100 FROM (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS v, row_number() OVER (PARTITION BY event_type ORDER BY CAST(round(value * 100) AS BIGINT), event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1"
)
def convergence_percentiles(spark, d):
    times = table(spark, d, "events").select("event_type", F.col("event_id").alias("node_id"), F.round(F.col("value") * 100).cast("long").alias("converged_ms"))
    return convergence.converged_share(times, ["event_type"])


_SWEEP = "sweep AS (SELECT user_id, event_id, CAST(event_id // 700 AS VARCHAR) AS root, event_id // 350 AS commits FROM events)"


def _sweeps(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", F.expr("event_id div 700").cast("string").alias("root"), F.expr("event_id div 350").alias("commits"))


@query("WITH " + _SWEEP + " SELECT user_id, event_id, coalesce(root = lag(root) OVER w, false) AND NOT coalesce(lag(root) OVER w = lag(root, 2) OVER w, false) AS converged FROM sweep WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def convergence_stamp(spark, d):
    return convergence.stamps(_sweeps(spark, d), ["user_id"], ["event_id"]).select("user_id", "event_id", "converged")


@query("WITH " + _SWEEP + ", i AS (SELECT *, CASE WHEN root = lag(root) OVER w AND commits = lag(commits) OVER w THEN 0 ELSE 1 END AS fresh FROM sweep WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM i) SELECT user_id, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM g GROUP BY user_id, run HAVING count(*) >= 3")
def quiescence(spark, d):
    return convergence.quiet_runs(_sweeps(spark, d), ["user_id"], ["event_id"], 3).select("user_id", "n", "first", "last")


@query("SELECT " + ", ".join(f"count(*) FILTER (WHERE value <= {b}) AS le_{k}" for k, b in enumerate((1, 2.5, 5, 10, 25, 50, 100, 250, 500))) + ", count(value) AS total FROM events")
def latency_histogram(spark, d):
    return convergence.histogram(table(spark, d, "events"), "value", (1, 2.5, 5, 10, 25, 50, 100, 250, 500)).drop("sum")


@query("WITH c AS (SELECT event_type, epoch_us(ts) // 3600000000 * 3600 AS s, count(*) AS k FROM events GROUP BY 1, 2), r AS (SELECT event_type, s, sum(k) OVER (PARTITION BY event_type ORDER BY s) AS n FROM c) SELECT event_type, s, round((n - lag(n) OVER w) / (s - lag(s) OVER w), 9) AS pps FROM r WINDOW w AS (PARTITION BY event_type ORDER BY s)")
def pps(spark, d):
    hours = table(spark, d, "events").groupBy("event_type", (F.floor(src.micros("ts") / 3600000000) * 3600).alias("s")).agg(F.count("*").alias("k"))
    counter = hours.withColumn("n", F.sum("k").over(Window.partitionBy("event_type").orderBy("s")))
    return convergence.per_second(counter, ["event_type"], "s").select("event_type", "s", F.round("pps", 9).alias("pps"))


@query(PLAIN + "SELECT seq, CASE WHEN tier_rank = 2 AND seq % 7 <> 0 THEN 'shipped' WHEN tier_rank = 2 THEN 'payload_miss' WHEN seq % 11 = 0 THEN 'pending' WHEN seq % 2 = 0 THEN 'shipped' ELSE 'relay_miss' END AS outcome FROM facts")
def ship_classification(spark, d):
    n = F.col("seq")
    return facts(spark, d).select("seq", convergence.ship_class(n % 7 != 0, F.col("tier_rank") == LIVE, F.when(n % 11 != 0, n % 2 == 0)).alias("outcome"))


@query("SELECT 'orders_' || lower(o_orderstatus) AS name, count(*) AS n, round(sum(CAST(printf('%.2f', o_totalprice) AS DOUBLE)), 2) AS total FROM orders GROUP BY 1")
def metrics_parse(spark, d):
    lines = table(spark, d, "orders").select(F.explode(F.array(F.concat(F.lit("orders_"), F.lower("o_orderstatus"), F.lit('{k="'), F.col("o_orderkey").cast("string"), F.lit('"} '), F.format_string("%.2f", "o_totalprice")), F.lit("# HELP orders_x y"), F.lit("other 1"))).alias("value"))
    return layout.parse_metrics(lines, "orders_").groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("sample"), 2).alias("total"))


# ---- scalar functions


@query(PLAIN + "SELECT seq, sha256(from_hex(dot_node_id || lpad(to_hex(system_time_ns), 16, '0')))[1:4] || '/' || payload_digest AS key FROM facts")
def sharded_key(spark, d):
    return facts(spark, d).select("seq", layout.sharded_key().alias("key"))


@query(PLAIN + "SELECT DISTINCT entity_id, sha256(entity_id)[1:16] AS hash8 FROM facts")
def entity_hash8(spark, d):
    return facts(spark, d).select("entity_id").distinct().select("entity_id", layout.entity_hash8().alias("hash8"))


@query(PLAIN + f"SELECT seq, {_DOT} AS dot FROM facts")
def dot_hex(spark, d):
    return facts(spark, d).select("seq", layout.dot_hex().alias("dot"))


@query("SELECT doc_id, sha256(regexp_replace(text, '[0-9]{12}', 'PII_REDACTED_', 'g')) AS masked, CAST(len(regexp_extract_all(text, '[0-9]{12}')) AS INTEGER) AS n FROM documents")
def mask_pii_mark(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(fn.pii_mark("text"), 256).alias("masked"), fn.pii_runs("text").alias("n"))


def _ascii_number(text: str, first: int, count: int) -> str:
    """Some characters of a text as a little-endian number."""
    return "CAST(" + " + ".join(f"CAST(ascii({text}[{first + k}]) AS UHUGEINT) * {1 << 8 * k}" for k in range(count)) + " AS UBIGINT)"


_PII = f"""WITH m AS (SELECT doc_id, text, regexp_extract_all(text, '[0-9]{{12}}') AS r, string_split_regex(text, '[0-9]{{12}}') AS parts FROM documents),
runs AS (SELECT doc_id, unnest(r) AS d, generate_subscripts(r, 1) AS k FROM m),
x1 AS (SELECT *, {_times(_ascii_number("d", 1, 8), _P2)} AS a, {_times(_ascii_number("d", 9, 4), _P1)} AS t FROM runs), x2 AS (SELECT *, xor(CAST({(_P5 + 12) % _M} AS UBIGINT), {_times(_rotated("a", 31), _P1)}) AS b FROM x1),
x3 AS (SELECT *, xor(CAST((CAST({_times(_rotated("b", 27), _P1)} AS UHUGEINT) + {_P4}) % {_M} AS UBIGINT), t) AS c FROM x2), x4 AS (SELECT *, CAST((CAST({_times(_rotated("c", 23), _P2)} AS UHUGEINT) + {_P3}) % {_M} AS UBIGINT) AS e FROM x3),
x5 AS (SELECT *, {_times("xor(e, e >> 33)", _P2)} AS f FROM x4), x6 AS (SELECT *, {_times("xor(f, f >> 29)", _P3)} AS g FROM x5),
hs AS (SELECT doc_id, list(lower(lpad(to_hex(xor(g, g >> 32)), 16, '0')) ORDER BY k) AS h FROM x6 GROUP BY doc_id)
SELECT m.doc_id, sha256(CASE WHEN text IS NULL THEN NULL WHEN h IS NULL THEN text ELSE parts[1] || array_to_string(list_transform(range(1, len(h) + 1), lambda i: 'PII_REDACTED_' || h[i] || parts[i + 1]), '') END) AS masked FROM m LEFT JOIN hs ON m.doc_id = hs.doc_id"""


@query(_PII)
def mask_pii(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(fn.mask_pii("text"), 256).alias("masked"))


@query("SELECT event_id, epoch_us(ts) * 1000 + event_id % 1000 AS ns FROM events")
def rfc3339_nanos(spark, d):
    nanos = F.lpad((F.pmod(src.micros("ts"), F.lit(1_000_000)) * 1000 + F.col("event_id") % 1000).cast("string"), 9, "0")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), nanos, F.lit("Z"))
    return table(spark, d, "events").select("event_id", fn.rfc3339_nanos(text).alias("ns"))


@query(PLAIN + "SELECT entity_id, count(*) AS n, max(system_time_ns) AS newest FROM facts WHERE tier_rank < 2 GROUP BY entity_id")
def layout_round_trip(spark, d):
    path = new_path(spark, "facts")
    layout.write_facts(facts(spark, d).where("tier_rank < 2"), path)
    return layout.read_facts(spark, path).groupBy("entity_id").agg(F.count("*").alias("n"), F.max("system_time_ns").alias("newest"))


# ---- streams over what is there now; the result is the batch's


@query(PLAIN + f"SELECT {_ROW} FROM facts")
def stream_join(spark, d):
    path = new_path(spark, "stream-state")
    events = ingest.files(spark, f"{d}/events.parquet", table(spark, d, "events").schema)
    ingest.drain(src.facts_from_events(events), ingest.join_sink(path), new_path(spark, "stream-checkpoint"))
    return spark.read.parquet(path).select(*ROW)


@query("SELECT lpad(CAST(event_id % 4 AS VARCHAR), 32, '0') AS dot_node_id, max(event_id + 1) AS lamport FROM events GROUP BY 1")
def stream_clocks(spark, d):
    path = new_path(spark, "stream-clocks")
    rows = src.facts_from_events(ingest.files(spark, f"{d}/events.parquet", table(spark, d, "events").schema))
    ingest.drain(ingest.clocks(rows), lambda batch, _: batch.write.mode("append").parquet(path), new_path(spark, "stream-checkpoint"), "update")
    return spark.read.parquet(path).groupBy("dot_node_id").agg(F.max("lamport").alias("lamport"))


@query("WITH sweep AS (SELECT user_id, event_id, CAST(event_id // 700 AS VARCHAR) AS root FROM events) SELECT user_id, event_id, coalesce(root = lag(root) OVER w, false) AND NOT coalesce(lag(root) OVER w = lag(root, 2) OVER w, false) AS converged FROM sweep WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def stream_stamps(spark, d):
    path = new_path(spark, "stream-stamps")
    rows = ingest.files(spark, f"{d}/events.parquet", table(spark, d, "events").schema).select("user_id", "event_id", F.expr("event_id div 700").cast("string").alias("root"))
    ingest.drain(rows, ingest.stamp_sink(path, ["user_id"], "event_id"), new_path(spark, "stream-checkpoint"))
    return spark.read.parquet(f"{path}/stamped").select("user_id", "event_id", "converged")


@query(PLAIN + "SELECT entity_id, count(*) FILTER (WHERE dot_counter < 8000) AS kept, count(*) FILTER (WHERE dot_counter >= 8000) AS dropped, coalesce(max(dot_counter) FILTER (WHERE dot_counter < 8000), 0) AS last FROM facts GROUP BY entity_id")
def stream_rates(spark, d):
    path = new_path(spark, "stream-rates")
    rows = src.facts_from_events(ingest.files(spark, f"{d}/events.parquet", table(spark, d, "events").schema))
    rates = ingest.peer_rates(rows.select("entity_id", "dot_counter"), "entity_id", "dot_counter", 8000)
    ingest.drain(rates, lambda batch, _: batch.write.mode("append").parquet(path), new_path(spark, "stream-checkpoint"), "update")
    return spark.read.parquet(path).groupBy("entity_id").agg(F.max("kept").alias("kept"), F.max("dropped").alias("dropped"), F.max("last").alias("last"))


@query(PLAIN + "SELECT count(*) AS n, max(dot_counter) AS lamport_high, max(dot_counter) + 1 AS cut_seq FROM facts")
def snapshot_round_trip(spark, d):
    rows, path = state(spark, d), new_path(spark, "snapshot")
    high = rows.agg(F.max("dot_counter")).first()[0]
    layout.write_snapshot(rows, path, replica.tree_root(rows).first().root, high, high + 1)
    back, meta = layout.read_snapshot(spark, path)
    ok = recovery.verify(back, meta["root"]).where("ok").select("root")
    return back.join(F.broadcast(ok)).agg(F.count("*").alias("n"), F.lit(meta["lamport_high"]).alias("lamport_high"), F.lit(meta["cut_seq"]).alias("cut_seq"))


@query(_ALONE.format(_ROW))
def sketch_delta(spark, d):
    return sketch.delta_by_sketch(*_two(spark, d)).select(*ROW)


@query("WITH u AS (SELECT s_nationkey AS n_nationkey, max(s_name) AS m FROM supplier GROUP BY 1) SELECT coalesce(n.n_nationkey, u.n_nationkey) AS n_nationkey, coalesce(u.m, n.n_name) AS n_name FROM nation n FULL JOIN u ON n.n_nationkey = u.n_nationkey")
def upsert(spark, d):
    updates = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_name").alias("n_name"))
    return replica.upsert(table(spark, d, "nation").select("n_nationkey", "n_name"), updates, ["n_nationkey"], ["n_name"])


@query(PLAIN + ", " + _FILES + ", keep AS (SELECT key FROM files WHERE NOT readable ORDER BY first_sys DESC, key DESC LIMIT 1000) SELECT key FROM keep UNION ALL SELECT DISTINCT 'l1/' || hash8 || '/0.arrow' FROM files WHERE readable")
def scan_plan(spark, d):
    files, man = _files(spark, d), _manifests(spark, d)
    return layout.scan_plan(man.select(F.col("l1_key").alias("key")).distinct(), files.select("key"), man)


@query(_SPLIT + " SELECT DISTINCT entity_id, dot_node_id, dot_counter FROM (SELECT * FROM a UNION ALL SELECT * FROM b)")
def resent_after_loss(spark, d):
    """What node b holds once node a has sent again whatever b lacks, some of it twice."""
    a, b = _two(spark, d)
    lacking = replica.difference(a, b)
    return replica.join(b, lacking.unionByName(lacking.where("seq % 2 = 0"))).select("entity_id", "dot_node_id", "dot_counter")


@query(f"SELECT 'user-' || CAST(user_id AS VARCHAR) AS entity_id, epoch_us(ts) * 1000 AS system_time_ns, epoch_us(ts) * 1000 - 5000 AS valid_time_start_ns, {OPEN_END} AS valid_time_end_ns, sha256(props) AS payload_digest FROM events WHERE value - 100 BETWEEN -90 AND 90")
def edge_ingest(spark, d):
    ns = src.micros("ts") * 1000
    edge = table(spark, d, "events").select((F.col("value") - 100).alias("latitude"), F.lit(10.0).alias("longitude"), (ns - 5000).alias("assertion_time"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("entity_id"), F.col("props").alias("payload"), ns.alias("arrival"))
    return src.facts_from_edge(edge, F.col("arrival")).select("entity_id", "system_time_ns", "valid_time_start_ns", "valid_time_end_ns", "payload_digest")


@query(PLAIN + "SELECT entity_id, dot_counter, dot_node_id AS origin_node_id, system_time_ns, payload_digest, 0 AS valid_time_start_ns FROM facts WHERE seq % 64 NOT IN (25, 63)")
def legacy_restore(spark, d):
    kind = F.when((F.col("seq") % 64).isin(25, 63), recovery.CHECKPOINT).otherwise(recovery.MUTATION)
    return recovery.legacy_entries(facts(spark, d).withColumn("type", kind)).select("entity_id", "dot_counter", "origin_node_id", "system_time_ns", "payload_digest", "valid_time_start_ns")
