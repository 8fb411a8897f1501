"""Bitemporal reads for all entities at once. Times are nanoseconds; valid time is half-open, visibility is <=."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.facts import LIVE
from .intervals import NODE, on_nodes, pairs_are_few
from .ordered import next_in_key, rank_in_key, running_max

#: Who wins among visible rows of an entity: the latest system time; on ties the compacted tier before the
#: flushed before the live one, then the smaller valid start and assertion time, then the smaller dot.
PRECEDENCE = "system_time_ns", "tier_rank", "valid_time_start_ns", "assertion_time_ns", "dot_node_id", "dot_counter"


def _precedence() -> list[Column]:
    return [F.col("system_time_ns").desc(), *(F.col(c).asc() for c in PRECEDENCE[1:])]


def _first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. Spark keeps one row a key in each task before it shuffles (WindowGroupLimit)."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def visible(facts: DataFrame, tx_ns: int) -> DataFrame:
    return facts.where(F.col("system_time_ns") <= tx_ns)


def at_point(v: Column | int) -> Column:
    return (F.col("valid_time_start_ns") <= v) & (F.col("valid_time_end_ns") > v)


def in_window(lo: int, hi: int) -> Column:
    return (F.col("valid_time_start_ns") < hi) & (F.col("valid_time_end_ns") > lo)


def of_entity(facts: DataFrame, entity: str | None) -> DataFrame:
    if entity == "":
        raise ValueError("an entity's id is not empty")
    return facts if entity is None else facts.where(F.col("entity_id") == entity)


def as_of(facts: DataFrame, valid_ns: int, tx_ns: int, entity: str | None = None) -> DataFrame:
    """The fact that holds at valid_ns as known at tx_ns, for each entity that has one. System times below 1 never win."""
    rows = visible(of_entity(facts, entity), tx_ns).where(at_point(valid_ns) & (F.col("system_time_ns") > 0))
    return _first(rows, ["entity_id"], _precedence())


def _prioritized(facts: DataFrame) -> DataFrame:
    """facts with `_prio`, a number by which a later one wins within its entity; it grows with the system time."""
    order = [F.col("system_time_ns").asc(), *(F.col(c).desc() for c in PRECEDENCE[1:])]
    return rank_in_key(facts, ["entity_id"], order, "_prio")


def as_of_join(coordinates: DataFrame, facts: DataFrame, direct: bool | None = None) -> DataFrame:
    """For each coordinate (coord_id, entity_id, valid_ns, tx_ns) the fact that holds there; nulls where none does.

    Facts and coordinates of an entity meet in nodes of valid time (see intervals); within a node, the winner is a running maximum
    in the order of system time. No fact is paired with a coordinate that it does not hold. Where no entity has many of both (or `direct`
    says so), they are joined plainly.
    """
    if pairs_are_few(coordinates, facts, "entity_id") if direct is None else direct:
        c, f = coordinates.withColumn("_row", F.monotonically_increasing_id()).alias("c"), facts.alias("f")
        hit = (F.col("c.entity_id") == F.col("f.entity_id")) & (F.col("f.system_time_ns") <= F.col("c.tx_ns")) & (F.col("f.system_time_ns") > 0)
        hit &= (F.col("f.valid_time_start_ns") <= F.col("c.valid_ns")) & (F.col("f.valid_time_end_ns") > F.col("c.valid_ns"))
        joined = c.join(f, hit, "left").select("c.*", *(F.col(f"f.{n}") for n in facts.columns if n != "entity_id"))
        return _first(joined, ["_row"], _precedence()).drop("_row")
    rows = _prioritized(facts.where("system_time_ns > 0 AND valid_time_end_ns > valid_time_start_ns"))
    points = coordinates.select("entity_id", "valid_ns", "tx_ns").distinct()
    dots, spans = on_nodes(points, rows.select("entity_id", "valid_time_start_ns", "valid_time_end_ns", "system_time_ns", "_prio"), "entity_id", "valid_ns", "valid_time_start_ns", "valid_time_end_ns")
    given = spans.select("entity_id", *NODE, F.col("system_time_ns").alias("_time"), F.lit(0).alias("_kind"), F.col("_prio"), F.lit(None).cast("long").alias("valid_ns"))
    asked = dots.select("entity_id", *NODE, F.col("tx_ns").alias("_time"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_prio"), "valid_ns")
    tops = running_max(given.unionByName(asked), ["entity_id", *NODE], ["_time", "_kind"], F.col("_prio"), "_best").where("_kind = 1")
    best = tops.groupBy("entity_id", "valid_ns", F.col("_time").alias("tx_ns")).agg(F.max("_best").alias("_prio"))
    won = coordinates.join(best, ["entity_id", "valid_ns", "tx_ns"], "left").join(rows, ["entity_id", "_prio"], "left")
    return won.select(*coordinates.columns, *(n for n in facts.columns if n != "entity_id"))


def range_join(windows: DataFrame, facts: DataFrame, direct: bool | None = None) -> DataFrame:
    """Each window (window_id, entity_id, lo, hi, tx_ns) with the facts of its entity, known by its time, whose interval meets [lo, hi).

    A fact meets a window if its start lies in the window, or the window's begin in the fact (after its start). Either is a join under
    equality of nodes (see intervals), so that only hits are paired; the system time is looked at afterwards. Where no entity has many of
    both (or `direct` says so), they are joined plainly.
    """
    if pairs_are_few(windows, facts, "entity_id") if direct is None else direct:
        both = windows.where("hi > lo").select("window_id", "lo", "hi", "tx_ns", "entity_id").join(facts, "entity_id")
        return both.where("system_time_ns <= tx_ns AND valid_time_start_ns < hi AND valid_time_end_ns > lo")
    asked = windows.where("hi > lo").select("window_id", "entity_id", "lo", "hi", "tx_ns")
    facts_by_number = _prioritized(facts)
    rows = facts_by_number.select("entity_id", "_prio", "valid_time_start_ns", "valid_time_end_ns", "system_time_ns")
    # facts that start inside; one that ends before it began, or where it began, meets a window only if it ends after lo
    dots, spans = on_nodes(rows, asked, "entity_id", "valid_time_start_ns", "lo", "hi")
    inside = spans.join(dots, ["entity_id", *NODE]).where("system_time_ns <= tx_ns AND valid_time_end_ns > lo")
    # facts that started before and have not ended
    dots, spans = on_nodes(asked, rows.withColumn("_after", F.col("valid_time_start_ns") + 1).where("valid_time_end_ns > valid_time_start_ns"), "entity_id", "lo", "_after", "valid_time_end_ns")
    around = dots.join(spans, ["entity_id", *NODE]).where("system_time_ns <= tx_ns")
    columns = ["window_id", "lo", "hi", "tx_ns", "entity_id", "_prio"]
    return inside.select(*columns).unionByName(around.select(*columns)).join(facts_by_number, ["entity_id", "_prio"]).drop("_prio")


def range_window(facts: DataFrame, lo: int, hi: int, tx_ns: int, entity: str | None = None) -> DataFrame:
    """Visible facts whose interval meets [lo, hi)."""
    if hi <= lo:
        raise ValueError("the window is empty")
    return visible(of_entity(facts, entity), tx_ns).where(in_window(lo, hi))


def range_capped(facts: DataFrame, lo: int, hi: int, tx_ns: int, entity: str, most: int = 4096) -> tuple[DataFrame, bool]:
    """At most `most` rows of one entity's window (0: all; negative as 0) by valid start, and whether there were more."""
    rows = range_window(facts, lo, hi, tx_ns, entity)
    if most <= 0:
        return rows, False
    order = [F.col("valid_time_start_ns"), *_precedence()]
    return rows.orderBy(*order).limit(most), rows.limit(most + 1).count() > most


def range_top(facts: DataFrame, lo: int, hi: int, tx_ns: int, most: int) -> DataFrame:
    """The capped window of every entity: `truncated` says whether the entity has more rows than `most`."""
    rows = range_window(facts, lo, hi, tx_ns)
    w = Window.partitionBy("entity_id").orderBy("valid_time_start_ns", *_precedence())
    top = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    total = rows.groupBy("entity_id").agg(F.count("*").alias("_n"))
    return top.join(total, "entity_id").withColumn("truncated", F.col("_n") > most).drop("_n")


def coalesce_range(rows: DataFrame) -> DataFrame:
    """Per entity and distinct valid start the row with the latest system time."""
    return _first(rows, ["entity_id", "valid_time_start_ns"], _precedence())


def timeline(facts: DataFrame, tx_ns: int, direct: bool | None = None) -> DataFrame:
    """Which fact holds on each stretch of valid time: (entity, from, to, winner), neighbours with one winner joined.

    An extension. Valid time is cut wherever a fact of the entity begins or ends; each stretch has its own winner.
    """
    rows = visible(facts, tx_ns).where("system_time_ns > 0 AND valid_time_end_ns > valid_time_start_ns")
    edges = rows.select("entity_id", F.explode(F.array("valid_time_start_ns", "valid_time_end_ns")).alias("at")).distinct()
    stretches = next_in_key(edges, ["entity_id"], ["at"], "at", "until").where("until IS NOT NULL")
    rows = _prioritized(rows)
    own = rows.select("entity_id", "valid_time_start_ns", "valid_time_end_ns", "_prio")
    if pairs_are_few(stretches, own, "entity_id") if direct is None else direct:
        held = stretches.join(own, "entity_id").where("valid_time_start_ns <= at AND valid_time_end_ns > at")
    else:
        dots, spans = on_nodes(stretches, own, "entity_id", "at", "valid_time_start_ns", "valid_time_end_ns")
        tops = spans.groupBy("entity_id", *NODE).agg(F.max("_prio").alias("_prio"))
        held = dots.join(tops, ["entity_id", *NODE])
    best = held.groupBy("entity_id", "at", "until").agg(F.max("_prio").alias("_prio"))
    # neighbours with one winner: a stretch is fresh unless the one before ends where it begins and has its winner
    before = next_in_key(best.withColumn("_back", -F.col("at")), ["entity_id"], ["_back"], "until", "_until", "_prio")
    fresh = ~F.coalesce((F.col("_until") == F.col("at")) & (F.col("_next_prio") == F.col("_prio")), F.lit(False))
    islands = running_max(before.withColumn("_fresh", fresh), ["entity_id"], ["at"], F.when(F.col("_fresh"), F.col("at")), "_island")
    spans = islands.groupBy("entity_id", "_island", "_prio").agg(F.min("at").alias("from_ns"), F.max("until").alias("to_ns"))
    return spans.join(rows.select("entity_id", "_prio", "dot_node_id", "dot_counter"), ["entity_id", "_prio"]).select("entity_id", "dot_node_id", "dot_counter", "from_ns", "to_ns")


def live_merge_as_of(facts: DataFrame, valid_ns: int, tx_ns: int) -> DataFrame:
    """as_of over stored and live rows; a live row wins only by a later system time."""
    return as_of(facts, valid_ns, tx_ns)


def live_merge_range(facts: DataFrame, lo: int, hi: int, tx_ns: int) -> DataFrame:
    """Stored rows of the window, and each live (system time, digest) of it that no stored row of the entity has, once."""
    rows = range_window(facts, lo, hi, tx_ns)
    kept, live = rows.where(F.col("tier_rank") != LIVE), rows.where(F.col("tier_rank") == LIVE)
    key = ["entity_id", "system_time_ns", "payload_digest"]
    return kept.unionByName(_first(live.join(kept.select(*key).distinct(), key, "left_anti"), key, _precedence()))


def live_read(live: DataFrame, tx_ns: int, entity: str | None = None) -> DataFrame:
    """What a replica that has not flushed yet tells others: its facts known at tx_ns, without their payloads."""
    return visible(of_entity(live, entity), tx_ns).withColumn("payload", F.lit(None).cast("string"))


def with_live(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Stored facts and those of a live source as one table, for the merges above; the live ones come last in ties."""
    rows = live.withColumn("tier_rank", F.lit(LIVE))
    return stored.unionByName(rows.select(*(c for c in stored.columns if c in rows.columns)), allowMissingColumns=True)


def latest_dot(state: DataFrame) -> DataFrame:
    """Each entity's row with the largest counter; on ties the smallest node."""
    return _first(state, ["entity_id"], [F.col("dot_counter").desc(), F.col("dot_node_id").asc()])


def checkpoint_latest(state: DataFrame) -> DataFrame:
    """Each entity's row with the largest (node, counter): another rule than latest_dot."""
    return _first(state, ["entity_id"], [F.col("dot_node_id").desc(), F.col("dot_counter").desc()])


def with_payload(latest: DataFrame, payloads: DataFrame) -> DataFrame:
    """latest with the payload that its originator keeps for the dot, if any."""
    return latest.drop("payload").join(payloads.select("entity_id", "dot_node_id", "dot_counter", "payload"), ["entity_id", "dot_node_id", "dot_counter"], "left")
