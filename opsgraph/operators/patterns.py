"""Recurring failures with temporal precursors, learned causes and their ranking, timelines.

Events: ``asset``, ``event_id``, ``kind``, ``day`` (date, may be null), ``codes`` (array), ``text``.

A precursor of a failure is another code on the same asset 1 to 30 days before.  Instead of joining events with
events, the days on which a code is in force for what follows are set as bits of blocks of 32 days (two blocks an event,
or'ed by asset, code and block) and joined by equality, so the work grows with the events and not with the square of an
asset's events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import component, extract_tags, failure_codes, failure_name, parse_day

GROUP = ["asset", "code", "component"]
#: Days of a block, a bit each.
BLOCK = 32


def asset_events(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Work orders and incidents of each asset out of the graph."""
    kinds = F.when(F.col("type") == "PERFORMED_ON", "WorkOrder").when(F.col("type") == "OCCURRED_AT", "Incident")
    placed = edges.withColumn("kind", kinds).where("kind is not null").select(F.col("target").alias("asset"), F.col("source").alias("key"), "kind")
    exhibited = edges.where("type = 'EXHIBITS'").groupBy(F.col("source").alias("key")).agg(F.sort_array(F.collect_set(F.regexp_replace("target", "^[^:]*:", ""))).alias("codes"))
    prop = lambda p: F.try_element_at("props", F.lit(p))
    about = nodes.select("key", parse_day(prop("date")).alias("day"), F.coalesce(F.nullif(prop("problem_text"), F.lit("")), F.nullif(prop("description"), F.lit("")), F.lit("")).alias("text"))
    out = placed.join(about, "key").join(exhibited, "key", "left")
    strip = lambda c: F.regexp_replace(c, "^[^:]*:", "")
    return out.select(strip("asset").alias("asset"), strip("key").alias("event_id"), "kind", "day", F.coalesce("codes", F.expr("cast(array() as array<string>)")).alias("codes"), "text")


def failures(events: DataFrame) -> DataFrame:
    """A row for each event and code, with the component that the text names."""
    return events.select("asset", "event_id", "day", F.explode(F.array_distinct("codes")).alias("code"), component("text").alias("component"))


def precursors(events: DataFrame, days: int = V.PRECURSOR_DAYS, scoped: bool = True) -> DataFrame:
    """For each group (asset, code, component) and preceding code: ``matched`` events of the group, of ``target_total``
    dated ones.  Unscoped, the component is null throughout."""
    targets = failures(events).where("day is not null")
    if not scoped:
        targets = targets.withColumn("component", F.lit(None).cast("string"))
    daily = targets.groupBy(*GROUP, "day").agg(F.count("*").alias("n"))
    total = daily.groupBy(*GROUP).agg(F.sum("n").alias("target_total"))
    span, start = F.unix_date("day"), F.col("block") * BLOCK
    blocks = F.sequence(F.floor((span + 1) / BLOCK), F.floor((span + days) / BLOCK))
    seen = events.where("day is not null").select("asset", span.alias("d"), F.explode("codes").alias("before"), blocks.alias("blocks")).select("asset", "d", "before", F.explode("blocks").alias("block"))
    low, high = F.greatest(F.col("d") + 1, start) - start, F.least(F.col("d") + days, start + (BLOCK - 1)) - start
    bits = F.expr("shiftleft(1L, cast(high + 1 as int)) - shiftleft(1L, cast(low as int))")
    force = seen.select("asset", "before", "block", low.alias("low"), high.alias("high")).groupBy("asset", "before", "block").agg(F.bit_or(bits).alias("days"))
    placed = daily.withColumn("block", F.floor(span / BLOCK))
    met = placed.join(force, ["asset", "block"]).where("before <> code").where(F.expr(f"shiftright(days, cast(unix_date(day) - block * {BLOCK} as int)) & 1 = 1")).groupBy(*GROUP, "before").agg(F.sum("n").alias("matched"))
    same = [met[c].eqNullSafe(total[c]) for c in GROUP]
    return met.join(total, same[0] & same[1] & same[2]).select(*[met[c] for c in GROUP], F.col("before").alias("precursor"), "matched", "target_total")


def pattern_cards(events: DataFrame, least: int = V.PATTERN_EVENTS, days: int = V.PRECURSOR_DAYS) -> DataFrame:
    """Groups of at least ``least`` events with span, evidence, most common precursor (of equals the first code),
    strength and recommendation."""
    rows = failures(events)
    # The first eight of a group by a ranking that limits before it moves, not out of a list of all.
    first = Window.partitionBy(*GROUP).orderBy(F.coalesce("day", F.to_date(F.lit("0001-01-01"))), "event_id")
    few = rows.select(*GROUP, "day", "event_id", F.row_number().over(first).alias("place")).where("place <= 8")
    evidence = few.groupBy(*[F.col(c).alias(f"e_{c}") for c in GROUP]).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "event_id"))), lambda x: x["event_id"]).alias("evidence"))
    groups = rows.groupBy(*GROUP).agg(F.count("*").alias("events"), F.round(F.coalesce(F.datediff(F.max("day"), F.min("day")), F.lit(0)) / 365.0, 1).alias("span_years"), F.count("day").alias("target_total")).where(F.col("events") >= least)
    own = [groups[c].eqNullSafe(evidence[f"e_{c}"]) for c in GROUP]
    groups = groups.join(evidence, own[0] & own[1] & own[2]).select(*GROUP, "events", "span_years", "evidence", "target_total")
    best = precursors(events, days).groupBy(*GROUP).agg(F.min(F.struct((-F.col("matched")).alias("m"), "precursor")).alias("b")).select(*[F.col(c).alias(f"b_{c}") for c in GROUP], F.col("b.precursor").alias("precursor"), (-F.col("b.m")).alias("matched"))
    on = [groups[c].eqNullSafe(best[f"b_{c}"]) for c in GROUP]
    cards = groups.join(best, on[0] & on[1] & on[2], "left").drop(*[f"b_{c}" for c in GROUP])
    share = F.when(F.col("target_total") > 0, F.coalesce("matched", F.lit(0)) / F.col("target_total")).otherwise(0.0)
    name = failure_name("code")
    cards = cards.withColumns({"share": share, "failure_name": F.when(F.col("component").isNotNull(), F.concat("component", F.lit(" "), F.lower(name))).otherwise(name)})
    cards = cards.withColumn("strength", F.round(F.col("events") * (0.1 + 3 * F.col("share") * F.col("share")), 2))
    return cards.withColumn("recommendation", recommendation(days)).orderBy(F.desc("strength"), *GROUP)


def recommendation(days: int):
    leading = F.format_string("%s is a leading indicator: %s of %s %s events on %s followed it within %s days. Trend it and act before failure.", failure_name("precursor"), F.col("matched").cast("string"), F.col("target_total").cast("string"), F.col("failure_name"), F.col("asset").cast("string"), F.lit(str(days)))
    plain = F.format_string("%s shows recurring %s. Review the maintenance strategy and find the root cause.", F.col("asset").cast("string"), F.col("failure_name"))
    return F.when(F.col("precursor").isNotNull() & (F.col("share") >= V.PRECURSOR_SHARE), leading).otherwise(plain)


def mine_causes(cards: DataFrame, least: float = V.PRECURSOR_SHARE) -> DataFrame:
    """Learned links ``code`` to ``cause``: the card of each with its share as confidence."""
    good = cards.where(F.col("precursor").isNotNull() & (F.col("share") >= least) & (F.col("precursor") != F.col("code")))
    span = F.concat_ws("", F.col("asset").cast("string"), F.lit(": "), F.col("matched").cast("string"), F.lit("/"), F.col("target_total").cast("string"), F.lit(f" within {V.PRECURSOR_DAYS}d"))
    return good.select("code", F.col("precursor").alias("cause"), F.round("share", 2).alias("confidence"), span.alias("evidence"))


def cause_edges(causes: DataFrame) -> DataFrame:
    """The learned links as HAS_CAUSE edges for a merge."""
    from .graph import provenance

    stamp = provenance(F.lit("M6-mined"), "pattern_mining", F.col("confidence"), span=F.col("evidence"))
    return causes.select(F.concat(F.lit("FailureMode:"), "code").alias("source"), F.lit("HAS_CAUSE").alias("type"), F.concat(F.lit("FailureMode:"), "cause").alias("target"), F.array(stamp).alias("provenance"), F.monotonically_increasing_id().alias("ord"))


def rank_causes(observed: DataFrame, events: DataFrame, causes: DataFrame, most: int = 3) -> DataFrame:
    """For each ``asset``, ``code``, ``component`` observed (a null component is any): the causes by score, 2 times the
    best confidence of learned links plus 1.5 times the share of past events that the most common precursor preceded."""
    learned = causes.groupBy("code", "cause").agg((2.0 * F.max("confidence")).alias("score")).join(observed.select("asset", "code", "component"), "code").select("asset", "code", "component", "cause", "score", F.lit("learned causal link").alias("basis"))
    history = precursors(events, scoped=False).unionByName(precursors(events).where("component is not null"))
    best = history.groupBy(*GROUP).agg(F.min(F.struct((-F.col("matched")).alias("m"), "precursor", "target_total")).alias("b"))
    on = (observed["asset"] == best["asset"]) & (observed["code"] == best["code"]) & observed["component"].eqNullSafe(best["component"])
    share = -F.col("b.m") / F.col("b.target_total")
    basis = F.concat(F.lit("preceded "), (-F.col("b.m")).cast("string"), F.lit("/"), F.col("b.target_total").cast("string"), F.lit(" past events"))
    past = observed.join(best, on).select(observed["asset"], observed["code"], observed["component"], F.col("b.precursor").alias("cause"), (1.5 * share).alias("score"), basis.alias("basis"))
    both = learned.withColumn("n", F.lit(0)).unionByName(past.withColumn("n", F.lit(1)))
    scored = both.groupBy(*GROUP, "cause").agg(F.round(F.sum("score"), 4).alias("score"), F.max_by("basis", "n").alias("basis"))
    w = Window.partitionBy(*GROUP).orderBy(F.desc("score"), "cause")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def observed_in(texts: DataFrame, text: str = "text") -> DataFrame:
    """Asset, code and component that a work order's text names first."""
    return texts.select("*", F.get(extract_tags(text), F.lit(0)).alias("asset"), F.get(failure_codes(text), F.lit(0)).alias("code"), component(text).alias("component"))


def timeline(events: DataFrame) -> DataFrame:
    """Dated events in order of asset, day and id: sorted codes, text of 90 characters."""
    return events.where("day is not null").select("asset", "event_id", "kind", "day", F.sort_array("codes").alias("codes"), F.substring("text", 1, 90).alias("text")).orderBy("asset", "day", "event_id")
