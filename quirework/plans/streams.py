"""Queries over event logs, delivery tables and frame labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quirework.functions import text as X, values as V
from quirework.operators import delivery, layout, sequences, statistics
from quirework.session import table
from quirework.sources import files
from quirework.streaming import frames

USER, ORDER = ["user_id"], ["ts", "event_id"]
NOW = "2024-01-31 00:00:00"


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


def _outbox(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "delivery_outbox")


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    """One row a frame: redelivered anchors keep the smallest anchor id."""
    return sequences.best_of(table(spark, folder, "scanner_video_v3a2_temporal_labels"), ["recording_id", "frame_index"], [-F.col("anchor_id")], ["anchor_id", "label", "page_spread", "captured_at"])


def _kind() -> Column:
    return F.lower(F.regexp_replace("label", "[^A-Za-z]", ""))


def event_scopes(spark: SparkSession, folder: str) -> DataFrame:
    """WIN-03: a user's scopes from one sign-up to the next."""
    s = sequences.scope_starts(_events(spark, folder), USER, ORDER, F.col("event_type") == "signup")
    return s.groupBy("user_id", "scope").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"), F.min("ts").alias("first_ts"))


def event_runs(spark: SparkSession, folder: str) -> DataFrame:
    """WIN-08: stretches of one event type."""
    return sequences.island_rows(_events(spark, folder), USER, ORDER, "event_type", "ts")


def event_token_runs(spark: SparkSession, folder: str) -> DataFrame:
    """WIN-04: runs in which errors go with what they interrupt."""
    kind = F.when(F.col("event_type") == "error", "OTHER").when(F.col("event_type").isin("click", "view"), "TEXT").otherwise("MATH")
    r = sequences.token_runs(_events(spark, folder).withColumn("kind", kind), USER, ORDER, "kind")
    return r.groupBy("user_id", "run").agg(F.min("run_kind").alias("run_kind"), F.count("*").alias("n"))


def event_changes(spark: SparkSession, folder: str) -> DataFrame:
    """WIN-08: event types that stood twice in a row, where they did."""
    return sequences.changed_after(_events(spark, folder), USER, ORDER, "event_type", 2).select("user_id", "event_id", "event_type", "previous")


def event_stability(spark: SparkSession, folder: str) -> DataFrame:
    """WIN-07: range of the last three values."""
    return sequences.range_stability(_events(spark, folder), USER, ORDER, {"value": 10.0}).select("user_id", "event_id", "state")


def event_pair_stability(spark: SparkSession, folder: str) -> DataFrame:
    """WIN-06: steps among the last three values."""
    return sequences.pair_stability(_events(spark, folder), USER, ORDER, "ts", {"value": 10.0}).select("user_id", "event_id", "state")


def event_best(spark: SparkSession, folder: str) -> DataFrame:
    """WIN-05: each user's best event by several ranks."""
    return sequences.best_of(_events(spark, folder), USER, [F.col("value"), F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id")], ["event_id", "value"])


def event_ring(spark: SparkSession, folder: str) -> DataFrame:
    """STM-06: the last 32 events of each user."""
    return sequences.last_n(_events(spark, folder), USER, ORDER, 32).select("user_id", "event_id")


def event_window_drops(spark: SparkSession, folder: str) -> DataFrame:
    """STM-03: fill and drops of a window of five."""
    return sequences.window_drops(_events(spark, folder), USER, ORDER, 5).select("user_id", "event_id", F.col("held").cast("int").alias("held"), F.col("dropped").cast("int").alias("dropped"))


def event_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """WIN-11, WIN-13: the events before and after."""
    return sequences.neighbours(_events(spark, folder), USER, ORDER, "event_type").select("user_id", "event_id", "previous_item", "next_item")


def event_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """STM-17, STM-18: how often one type follows another."""
    return sequences.transitions(_events(spark, folder), USER, ORDER, "event_type")


def event_only_changes(spark: SparkSession, folder: str) -> DataFrame:
    """SNK-03: events whose type differs from the one before."""
    return sequences.only_changes(_events(spark, folder), USER, ORDER, F.col("event_type")).select("user_id", "event_id")


def event_holds(spark: SparkSession, folder: str) -> DataFrame:
    """WIN-09: types that held for two samples and an hour."""
    return sequences.held(_events(spark, folder), USER, ORDER, "event_type", "ts", 2, 3_600_000)


def event_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """WIN-10: when a user's first twenty events decide whether errors are frequent."""
    return sequences.first_decision(_events(spark, folder), USER, ORDER, F.col("event_type") == "error", 20, 6, 3)


def event_props(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-02, STR-13: a field of the JSON properties by type, with the properties read as lines of an event log."""
    e = files.event_lines(_events(spark, folder), "props", "k string")
    k = X.safe_int("k")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("with_k"), F.sum(k).alias("sum_k"))


def event_presence(spark: SparkSession, folder: str) -> DataFrame:
    """DAT-01, AGG-18: presence of each user, with event types as sessions."""
    sessions = _events(spark, folder).groupBy("user_id", "event_type").agg(F.max("ts").cast("timestamp").alias("ts"))
    return delivery.presence(sessions, "user_id", "ts", F.lit(NOW).cast("timestamp"), 86400.0, 4 * 86400.0)


def event_hours(spark: SparkSession, folder: str) -> DataFrame:
    """DAT-02, DAT-03: events by local day and hour, and those within the last three days."""
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Seoul")
    recent = F.col("ts").cast("timestamp") > F.lit(NOW).cast("timestamp") - F.expr("interval 3 days")
    return _events(spark, folder).groupBy(F.date_format(local, "yyyy-MM-dd HH").alias("local_hour")).agg(F.count("*").alias("n"), F.count_if(recent).alias("recent"))


def event_report(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-28: a user's checks folded from events."""
    t, v = F.col("event_type"), F.col("value")
    return delivery.folded_report(_events(spark, folder), "user_id", {"signed_up": (t == "signup", F.lit(False)), "bought": (t == "purchase", (t == "purchase") & (v < 0)), "calm": (t == "view", (t == "error") & (v > 30))})


def event_autocorrelation(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-23: autocorrelation of each user's error indicator."""
    e = _events(spark, folder).withColumn("hit", F.when(F.col("event_type") == "error", 1.0).otherwise(0.0))
    return statistics.autocorrelation(e, USER, ORDER, "hit").select("user_id", "lag", F.round("rho", 6).alias("rho"))


def event_effective_size(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-23: effective sample size of each user's error indicator."""
    e = _events(spark, folder).withColumn("hit", F.when(F.col("event_type") == "error", 1.0).otherwise(0.0))
    return statistics.effective_size(statistics.autocorrelation(e, USER, ORDER, "hit"), USER).select("user_id", F.round("ess", 4).alias("ess"))


def event_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-24: block bootstrap of each user's mean value."""
    return statistics.block_bootstrap(_events(spark, folder), USER, ORDER, "value", 5)


def event_consensus(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-16: each user's most frequent event type, of equals the one seen first."""
    return statistics.consensus(_events(spark, folder), USER, "event_type", "event_id")


def event_wilson(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-22: Wilson interval of the error share by user, bound without errors, chance of an error in three."""
    out = _events(spark, folder).groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("hits"), F.count("*").alias("n"))
    w = statistics.wilson(F.col("hits"), F.col("n"))
    p = F.col("hits") / F.col("n")
    return out.select("user_id", "hits", "n", F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"), F.round(statistics.zero_error_bound(F.col("n")), 6).alias("zero_bound"), F.round(statistics.any_of(p, F.lit(3)), 6).alias("any_of_3"))


def event_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-21, GRD-11: all threshold pairs scored on users, the even ones expected SAME."""
    counts = sequences.top_k(_events(spark, folder), USER, ORDER, 10).groupBy("user_id").agg(F.count_if(F.col("event_type").isin("error", "click")).alias("matches"))
    return statistics.score_thresholds(counts.withColumn("expected", F.when(F.col("user_id") % 2 == 0, "SAME").otherwise("DIFFERENT")), 10)


def event_indicators(spark: SparkSession, folder: str) -> DataFrame:
    """JN-11: whether a user's value was seen among sign-ups, one row a query."""
    e = _events(spark, folder).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    q = e.where("event_type = 'purchase'").select(F.col("event_id").alias("query_id"), "cents")
    return statistics.match_indicators(q, e.where("event_type = 'signup'").select("cents"), ["cents"])


def event_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-11: mean, median, tenth percentile and low share by type."""
    out = statistics.spread_summary(_events(spark, folder), ["event_type"], "value", 5.0)
    return out.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.round("p10", 6).alias("p10"), F.round("low_share", 6).alias("low_share"))


def event_cadence(spark: SparkSession, folder: str) -> DataFrame:
    """STM-01: events that a sampler accepts which waits a day after each one."""
    e = _events(spark, folder).withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return sequences.cadence_samples(e, "user_id", "s", 86400.0, "event_id")


def _frames(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled frames with what the stateful operators read."""
    w = Window.partitionBy("recording_id").orderBy("frame_index")
    f = _labels(spark, folder).withColumn("kind", _kind()).withColumn("spread", F.lower("page_spread"))
    clean = F.col("kind") == "cleantransferable"
    f = f.withColumn("before", F.lag("spread").over(w)).withColumn("n", F.row_number().over(w))
    relation = F.when(F.col("spread").isNull() | F.col("before").isNull(), "SAME").when(F.col("spread") == F.col("before"), "REPEAT").otherwise("CHANGED")
    return f.select(
        "recording_id", (F.unix_micros(F.col("captured_at").cast("timestamp")) / 1e6).alias("t"), F.col("frame_index").cast("long").alias("frame"), relation.alias("relation"), clean.alias("eligible"), (F.col("n") % 20 == 1).alias("armed"),
        F.col("spread").alias("value"), F.lit(None).cast("array<string>").alias("bank"), (relation == "CHANGED").alias("changed"), F.when(~clean, F.col("kind")).alias("reason"), clean.alias("down"),
        F.when(relation == "CHANGED", "DIFFERENT").when(relation == "REPEAT", "SAME").otherwise("UNKNOWN").alias("identity"), (F.col("n") % 7 == 0).alias("numeric_differs"),
        F.when(F.col("n") % 2 == 1, "PUT").otherwise("CONFIRM").alias("action"), F.coalesce("spread", F.lit("none")).alias("artifact"),
    )


def frame_page_changes(spark: SparkSession, folder: str) -> DataFrame:
    """STM-04: page changes by hysteresis."""
    return frames.page_change(2).batch(_frames(spark, folder), "recording_id")


def frame_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """STM-05: verdicts of the observation collector."""
    return frames.collector(3, 2, 0, 5.0).batch(_frames(spark, folder), "recording_id")


def frame_checks(spark: SparkSession, folder: str) -> DataFrame:
    """STM-07: when the expensive check runs, counted by reason."""
    return frames.verification().batch(_frames(spark, folder), "recording_id").groupBy("action", "reason").agg(F.count("*").alias("n"))


def frame_guidance(spark: SparkSession, folder: str) -> DataFrame:
    """WIN-09: reasons that held, with a cool-down."""
    return frames.guidance(2, 0.5, 5.0).batch(_frames(spark, folder), "recording_id")


def frame_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """STM-06: how many artifacts each recording's ledger holds at its end."""
    return frames.ledger(32).batch(_frames(spark, folder), "recording_id").groupBy("recording_id").agg(F.max("held").alias("held"), F.count_if("known").alias("known"))


def frame_pulses(spark: SparkSession, folder: str) -> DataFrame:
    """STM-15: pulses while frames are clean."""
    return frames.pulses().batch(_frames(spark, folder), "recording_id")


def frame_fused_changes(spark: SparkSession, folder: str) -> DataFrame:
    """STM-21: page changes by identity and visual or numeric evidence."""
    return frames.fused_change(2).batch(_frames(spark, folder), "recording_id")


def outbox_heartbeats(spark: SparkSession, folder: str) -> DataFrame:
    """STM-10: outcomes of sequences in order of arrival, as the stateful operator gives them."""
    o = _outbox(spark, folder).withColumn("arrival", F.unix_micros(F.col("delivered_at").cast("timestamp")) * 1000 + F.col("delivery_row_id") % 1000)
    return frames.heartbeat().batch(o.select("scan_session_id", "arrival", "sequence", F.col("upload_digest").alias("digest")), "scan_session_id").groupBy("scan_session_id", "outcome").agg(F.count("*").alias("n"))


def event_pulses(spark: SparkSession, folder: str) -> DataFrame:
    """STM-15: pulses of a key that is held for as long as an event's value says."""
    e = _events(spark, folder).select("event_id", F.col("ts").cast("timestamp").alias("down"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.abs("value") * 100).cast("long") * 1000).alias("up"))
    return sequences.hold_pulses(e, "down", "up", 500, 250).select("event_id", "pulse_ms")


def label_grid(spark: SparkSession, folder: str) -> DataFrame:
    """STM-02, NUM-08: labelled frames on a grid of half a second."""
    return sequences.grid_samples(_labels(spark, folder), ["recording_id"], "frame_index", V.cadence_step(F.lit(59.7), F.lit(500))).select("recording_id", "frame_index")


def label_consensus(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-16: each recording's dominant label."""
    return statistics.consensus(_labels(spark, folder).withColumn("kind", _kind()), ["recording_id"], "kind", "frame_index")


def label_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """STM-17: label transitions over all recordings."""
    return sequences.transitions(_labels(spark, folder).withColumn("kind", _kind()), ["recording_id"], ["frame_index"], "kind")


def outbox_last_state(spark: SparkSession, folder: str) -> DataFrame:
    """STM-13: the last state of each outbox message."""
    return delivery.last_state(_outbox(spark, folder), ["outbox_id"], "status", "updated_at", "delivery_row_id")


def outbox_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """STM-09: keys that came again, with the same or other content."""
    return delivery.idempotency_conflicts(_outbox(spark, folder).where("idempotency_key is not null"), ["scan_session_id", "idempotency_key"], "upload_digest")


def outbox_replays(spark: SparkSession, folder: str) -> DataFrame:
    """STM-10: rows against the highest sequence of their session that arrived before."""
    return delivery.replay_outcomes(_outbox(spark, folder), ["scan_session_id"], ["delivered_at", "delivery_row_id"], "sequence", "upload_digest").select("delivery_row_id", "outcome")


def outbox_gapless(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-19: sessions whose sequences have no gap."""
    return delivery.gapless(_outbox(spark, folder), ["scan_session_id"], "sequence")


def outbox_cutoff(spark: SparkSession, folder: str) -> DataFrame:
    """STM-11: rows within the highest accepted sequence of their session."""
    cut = table(spark, folder, "scan_spreads").groupBy("scan_session_id").agg(F.max("sequence").alias("through"))
    return delivery.within_cutoff(_outbox(spark, folder), cut, ["scan_session_id"], "sequence", "through").groupBy("scan_session_id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("late"))


def outbox_flush(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-31: flush state of each session through its last sequence."""
    o = _outbox(spark, folder)
    return delivery.flush_status(o, ["scan_session_id"], "sequence", "status", o.groupBy("scan_session_id").agg(F.max("sequence").alias("through")), "through")


def outbox_retries(spark: SparkSession, folder: str) -> DataFrame:
    """STM-20: delay before the next try, plain and jittered."""
    o = _outbox(spark, folder).where("status = 'retrying'")
    delay = V.retry_delay(F.coalesce("attempt_count", F.lit(0)), 1.0, 60.0)
    return o.select("delivery_row_id", delay.alias("delay"), F.round(V.jittered(delay, 0.2, (F.col("delivery_row_id") % 100) / 100.0), 6).alias("jittered"))


def outbox_leases(spark: SparkSession, folder: str) -> DataFrame:
    """DAT-02, STM-12: leases of rows in delivery at a given time."""
    o = _outbox(spark, folder).withColumn("until", F.when(F.col("status") == "sending", F.col("updated_at").cast("timestamp") + F.expr("interval 300 seconds")))
    return delivery.lease_outcomes(o, "until", "attempt_count", F.lit("2026-06-01 00:00:00").cast("timestamp"), 3).groupBy("lease").agg(F.count("*").alias("n"))


def outbox_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-09: each message's largest size, summed by session."""
    return delivery.sum_of_max(_outbox(spark, folder), ["scan_session_id"], "outbox_id", "total_file_bytes")


def outbox_counts(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-10: conditional counts and sums over all rows."""
    return _outbox(spark, folder).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "acked").alias("acked"), F.count_if(F.col("last_error_code").isNotNull()).alias("errors"), F.coalesce(F.sum(F.when(F.col("status") == "acked", F.col("total_file_bytes"))), F.lit(0)).alias("acked_bytes"))


def outbox_digests(spark: SparkSession, folder: str) -> DataFrame:
    """HSH-01, HSH-03, JSN-02: page keys and joined digests of a message, and the key's parts."""
    o = _outbox(spark, folder).select("outbox_id", "scan_session_id", "sequence", "artifact_id", "spread_id").distinct()
    key = V.page_key("scan_session_id", "sequence", F.lit("L"))
    from quirework.functions.text import page_key_parts

    return o.select("outbox_id", key.alias("page_key"), V.joined_digest("artifact_id", "spread_id", digits=32).alias("receipt"), V.text_key("outbox_id").alias("text_key"), page_key_parts(key)["sequence"].alias("seq"), page_key_parts(key)["side"].alias("side")).distinct()


def outbox_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """JSN-01, HSH-02: canonical digest of the inventory."""
    return _outbox(spark, folder).select("delivery_row_id", V.canonical_digest_udf("inventory_json").alias("digest"))


def spread_counts(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-08: spreads by status, states without spreads included."""
    return delivery.zero_filled(table(spark, folder, "scan_spreads"), ["received", "processing", "ready", "rejected", "error", "sealed"], "status")


def spread_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-17: status of each session from its spreads."""
    return delivery.status_rollup(table(spark, folder, "scan_spreads"), ["scan_session_id"], "status", ["rejected", "error"], "ready", "processing")


def spread_queue(spark: SparkSession, folder: str) -> DataFrame:
    """JN-01, SRT-07: the first twenty spreads to work on, with the size of their session."""
    owners = _outbox(spark, folder).groupBy("scan_session_id").agg(F.count_distinct("outbox_id").alias("messages"))
    s = table(spark, folder, "scan_spreads").where("status in ('received', 'processing')").withColumn("rank", F.when(F.col("status") == "received", 0).otherwise(1))
    s = s.groupBy("scan_session_id", "sequence", "artifact_id", "rank").agg(F.min("received_at").alias("received_at"))
    return delivery.next_in_queue(s, owners, "scan_session_id", ["rank", "received_at", "scan_session_id", "sequence", "artifact_id"], 20)


def spread_nested(spark: SparkSession, folder: str) -> DataFrame:
    """JN-20: sessions with their spreads nested; how many and which first."""
    s = table(spark, folder, "scan_spreads")
    parents = _outbox(spark, folder).select("scan_session_id").distinct()
    n = delivery.nested(parents, s, ["scan_session_id"], ["sequence", "artifact_id"], "spreads")
    return n.select("scan_session_id", F.size("spreads").alias("n"), F.get("spreads", F.lit(0))["artifact_id"].alias("first_artifact"))


def spread_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """JN-19: spreads without an acked message, received before a given time."""
    known = _outbox(spark, folder).where("status = 'acked'").select("receipt_id").distinct()
    s = table(spark, folder, "scan_spreads")
    return delivery.orphans(s, known, "receipt_id", "received_at", F.lit("2026-07-01 00:00:00").cast("timestamp_ntz")).select("receipt_id", "artifact_id", "status").distinct()


def spread_revisions(spark: SparkSession, folder: str) -> DataFrame:
    """JN-02: each spread, named by session and sequence, joined to the delivery that is its current one (its last receipt)."""
    s = table(spark, folder, "scan_spreads").where("receipt_id is not null").groupBy("scan_session_id", "sequence").agg(F.max("receipt_id").alias("current"))
    items = s.select(F.concat_ws("/", "scan_session_id", "sequence").alias("spread"), "current")
    o = _outbox(spark, folder).where("receipt_id is not null").groupBy(F.concat_ws("/", "scan_session_id", "sequence").alias("spread"), "receipt_id").agg(F.max("attempt_count").alias("attempts"), F.count("*").alias("deliveries"))
    return delivery.current_revisions(items, o, "spread", "current", "receipt_id").select("spread", "receipt_id", "attempts", "deliveries")


def spread_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """SRT-06, SRT-09: the 32 sessions changed last, newest first, with a clamped index."""
    s = table(spark, folder, "scan_spreads").groupBy("scan_session_id").agg(F.max("updated_at").alias("updated_at"), F.count_distinct("sequence").alias("spreads"))
    top = s.orderBy(F.desc("updated_at"), "scan_session_id").limit(32)
    return top.withColumn("selected", layout.clamped(F.lit(40), F.col("spreads")).cast("int"))


_S = "PARTITION BY user_id ORDER BY ts, event_id"
_LABELS = "labels AS (SELECT recording_id, frame_index, arg_min(lower(regexp_replace(label, '[^A-Za-z]', '', 'g')), anchor_id) AS kind FROM scanner_video_v3a2_temporal_labels GROUP BY 1, 2)"
_ISLES = f"isles AS (SELECT *, sum(c) OVER ({_S}) AS island FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER ({_S}) THEN 0 ELSE 1 END AS c FROM events))"
_AUTO = f"""d AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END - avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY user_id) AS d, count(*) OVER (PARTITION BY user_id) AS n FROM events),
l AS (SELECT d.*, k.lag, lead(d, CAST(k.lag AS INTEGER)) OVER (PARTITION BY user_id, k.lag ORDER BY ts, event_id) AS e FROM d, (SELECT unnest(range(1, 11)) AS lag) k WHERE n > 1),
rho AS (SELECT user_id, CAST(lag AS INTEGER) AS lag, max(n) AS n, CASE WHEN sum(d * d) <= 1e-12 THEN 1.0 ELSE greatest(-1.0, least(1.0, coalesce(sum(d * e), 0) / sum(d * d))) END AS rho FROM l WHERE lag < n GROUP BY 1, 2)"""
_Z = statistics.Z95


def _replays(arrival: str) -> str:
    return f"""n AS (SELECT *, row_number() OVER (PARTITION BY scan_session_id ORDER BY {arrival}) AS k FROM delivery_outbox),
t AS (SELECT *, max(sequence) OVER w AS top, arg_max(upload_digest, sequence * CAST(1000000000 AS HUGEINT) - k) OVER w AS held FROM n WINDOW w AS (PARTITION BY scan_session_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
outcomes AS (SELECT *, CASE WHEN top IS NULL OR sequence > top THEN 'accepted' WHEN sequence < top THEN 'stale' WHEN upload_digest IS NOT DISTINCT FROM held THEN 'replay' ELSE 'collision' END AS outcome FROM t)"""


_FRAMES = """
placed AS (
  SELECT recording_id, epoch_us(captured_at) / 1e6 AS t, CAST(frame_index AS BIGINT) AS frame, lower(regexp_replace(label, '[^A-Za-z]', '', 'g')) AS kind, lower(page_spread) AS spread
  FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, frame_index ORDER BY anchor_id) AS first FROM scanner_video_v3a2_temporal_labels) WHERE first = 1),
seen AS (SELECT *, lag(spread) OVER w AS before, row_number() OVER w AS n FROM placed WINDOW w AS (PARTITION BY recording_id ORDER BY frame)),
frames AS (
  SELECT *, CASE WHEN spread IS NULL OR before IS NULL THEN 'SAME' WHEN spread = before THEN 'REPEAT' ELSE 'CHANGED' END AS relation, coalesce(kind = 'cleantransferable', false) AS eligible, n % 20 = 1 AS armed,
    CASE WHEN kind <> 'cleantransferable' THEN kind END AS reason, row_number() OVER (PARTITION BY recording_id ORDER BY t NULLS FIRST, frame) AS k FROM seen WHERE recording_id IS NOT NULL),
starts AS (SELECT DISTINCT recording_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS frame, CAST(NULL AS DOUBLE) AS t FROM frames)"""


def _folded(state: str, step: str, inner: str) -> str:
    """A recursive fold over each recording's frames: the first state, the next one, and what it is made of."""
    return f"WITH RECURSIVE {_FRAMES}, fold AS (SELECT *, {state} FROM starts UNION ALL SELECT recording_id, k, frame, t, {step} FROM (SELECT f.recording_id, f.k, f.frame, f.t, {inner} FROM fold s JOIN frames f ON f.recording_id = s.recording_id AND f.k = s.k + 1))"


SQL = {
    "frame_page_changes": _folded(
        "0 AS held, false AS latched, false AS fired", "CASE WHEN shut THEN was WHEN skip OR up >= 2 THEN 0 ELSE up END, shut OR (NOT skip AND up >= 2), NOT shut AND NOT skip AND up >= 2",
        "s.latched AND NOT f.armed AS shut, CASE WHEN f.armed THEN 0 ELSE s.held END AS was, NOT f.eligible OR f.relation = 'SAME' AS skip, CASE WHEN f.relation = 'REPEAT' AND s.held > 0 AND NOT f.armed THEN s.held + 1 ELSE 1 END AS up",
    ) + " SELECT recording_id, frame, t FROM fold WHERE fired",
    "frame_checks": _folded(
        "0 AS burst, 0 AS audit, '' AS reason", "CASE reason WHEN 'BURST' THEN b + 1 WHEN 'BURST_TIMEOUT' THEN b ELSE 0 END, CASE reason WHEN 'UNCHANGED' THEN a + 1 ELSE 0 END, reason",
        "s.burst AS b, s.audit AS a, CASE WHEN NOT f.eligible THEN 'INELIGIBLE' WHEN f.relation = 'CHANGED' THEN CASE WHEN s.burst >= 5 THEN 'BURST_TIMEOUT' ELSE 'BURST' END WHEN s.audit >= 3 THEN 'AUDIT' ELSE 'UNCHANGED' END AS reason",
    ) + " SELECT CASE WHEN reason IN ('BURST', 'AUDIT') THEN 'request' ELSE 'skip' END AS action, reason, count(*) AS n FROM fold WHERE k > 0 GROUP BY 1, 2",
    "frame_guidance": _folded(
        "CAST(NULL AS VARCHAR) AS reason, 0 AS n, CAST(NULL AS DOUBLE) AS since, CAST(NULL AS VARCHAR) AS said, CAST(NULL AS DOUBLE) AS at_t, false AS fired",
        "reason, n, since, CASE WHEN go THEN reason ELSE said END, CASE WHEN go THEN t ELSE at_t END, go",
        """f.reason, CASE WHEN f.reason IS NULL THEN 0 WHEN f.reason IS DISTINCT FROM s.reason THEN 1 ELSE s.n + 1 END AS n, CASE WHEN f.reason IS NOT NULL AND f.reason IS DISTINCT FROM s.reason THEN f.t ELSE s.since END AS since, s.said, s.at_t,
        f.reason IS NOT NULL AND CASE WHEN f.reason IS DISTINCT FROM s.reason THEN 1 ELSE s.n + 1 END >= 2 AND f.t - CASE WHEN f.reason IS DISTINCT FROM s.reason THEN f.t ELSE s.since END >= 0.5 AND NOT coalesce(s.said = f.reason AND f.t - s.at_t < 5.0, false) AS go""",
    ) + " SELECT recording_id, frame, reason FROM fold WHERE fired",
    "frame_pulses": _folded(
        "CAST(NULL AS DOUBLE) AS due, false AS fired", "CASE WHEN NOT eligible THEN NULL WHEN due IS NULL THEN t + 0.5 WHEN t >= due THEN t + 0.25 ELSE due END, eligible AND (due IS NULL OR t >= due)", "f.eligible, s.due",
    ) + " SELECT recording_id, frame, t FROM fold WHERE fired",
    "frame_ledger": _folded(
        "CAST(NULL AS VARCHAR) AS pending, CAST([] AS VARCHAR[]) AS ring, 0 AS known", "CASE WHEN put THEN artifact WHEN ok THEN NULL ELSE pending END, next, CASE WHEN list_contains(next, artifact) THEN 1 ELSE 0 END",
        """coalesce(f.spread, 'none') AS artifact, f.n % 2 = 1 AS put, f.n % 2 = 0 AND s.pending IS NOT DISTINCT FROM coalesce(f.spread, 'none') AS ok, s.pending,
        CASE WHEN f.n % 2 = 0 AND s.pending IS NOT DISTINCT FROM coalesce(f.spread, 'none') AND NOT list_contains(s.ring, coalesce(f.spread, 'none')) THEN list_append(s.ring, coalesce(f.spread, 'none'))[-32:] ELSE s.ring END AS next""",
    ) + " SELECT recording_id, CAST(max(len(ring)) AS INTEGER) AS held, CAST(sum(known) AS BIGINT) AS known FROM fold WHERE k > 0 GROUP BY 1",
    "event_scopes": f"SELECT user_id, scope, count(*) AS n, round(sum(value), 4) AS value, min(ts) AS first_ts FROM (SELECT *, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER ({_S}) AS BIGINT) AS scope FROM events) GROUP BY 1, 2",
    "event_runs": f"WITH {_ISLES} SELECT user_id, CAST(island AS BIGINT) AS island, min(event_type) AS event_type, count(*) AS n, min(ts) AS first_time, max(ts) AS last_time FROM isles GROUP BY 1, 2",
    "event_token_runs": f"""WITH k AS (SELECT *, CASE WHEN event_type = 'error' THEN NULL WHEN event_type IN ('click', 'view') THEN 'TEXT' ELSE 'MATH' END AS kind FROM events),
o AS (SELECT *, coalesce(last_value(kind IGNORE NULLS) OVER ({_S} ROWS UNBOUNDED PRECEDING), 'TEXT') AS run_kind FROM k), c AS (SELECT *, CASE WHEN run_kind = lag(run_kind) OVER ({_S}) THEN 0 ELSE 1 END AS c FROM o)
SELECT user_id, CAST(run AS BIGINT) AS run, min(run_kind) AS run_kind, count(*) AS n FROM (SELECT *, sum(c) OVER ({_S}) AS run FROM c) GROUP BY 1, 2""",
    "event_changes": f"""WITH {_ISLES}, nth AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS k FROM isles)
SELECT user_id, event_id, event_type, previous FROM (SELECT *, lag(event_type) OVER ({_S}) AS previous FROM nth WHERE k = 2) WHERE event_type IS DISTINCT FROM previous""",
    "event_stability": f"SELECT user_id, event_id, CASE WHEN count(*) OVER w < 3 THEN 'UNSTABLE' WHEN max(value) OVER w - min(value) OVER w <= 10 THEN 'STABLE' ELSE 'MOVING' END AS state FROM events WINDOW w AS ({_S} ROWS 2 PRECEDING)",
    "event_pair_stability": f"""WITH p AS (SELECT *, abs(value - lag(value) OVER ({_S})) AS d, lag(ts) OVER ({_S}) AS t FROM events)
SELECT user_id, event_id, CASE WHEN count(*) OVER w < 3 THEN 'UNSTABLE' WHEN max(CASE WHEN ts <= t THEN 1 ELSE 0 END) OVER v = 1 THEN 'STALE' WHEN max(d) OVER v <= 10 THEN 'STABLE' ELSE 'MOVING' END AS state FROM p WINDOW w AS ({_S} ROWS 2 PRECEDING), v AS ({_S} ROWS 1 PRECEDING)""",
    "event_best": "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "event_ring": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 32",
    "event_window_drops": f"SELECT user_id, event_id, CAST(least(k, 5) AS INTEGER) AS held, CAST(greatest(k - 5, 0) AS INTEGER) AS dropped FROM (SELECT *, row_number() OVER ({_S}) AS k FROM events)",
    "event_neighbours": f"SELECT user_id, event_id, lag(event_type) OVER ({_S}) AS previous_item, lead(event_type) OVER ({_S}) AS next_item FROM events",
    "event_transitions": f"SELECT p AS from_state, event_type AS to_state, count(*) AS n FROM (SELECT *, lag(event_type) OVER ({_S}) AS p FROM events) WHERE p IS NOT NULL GROUP BY 1, 2",
    "event_only_changes": f"SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER ({_S}) AS p FROM events) WHERE p IS NULL OR p <> event_type",
    "event_holds": f"""WITH {_ISLES}, m AS (SELECT *, row_number() OVER w AS k, min(ts) OVER w AS since FROM isles WINDOW w AS (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_type, since, min(ts) AS at, CAST(min(k) AS INTEGER) AS n FROM m WHERE k >= 2 AND epoch_us(ts) - epoch_us(since) >= 3600000000 GROUP BY user_id, island, event_type, since""",
    "event_decisions": f"""WITH m AS (SELECT user_id, i, sum(h) OVER (PARTITION BY user_id ORDER BY i) AS m FROM (SELECT user_id, row_number() OVER ({_S}) AS i, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS h FROM events) WHERE i <= 20),
d AS (SELECT user_id, min(i) FILTER (m >= 6 OR m + 20 - i <= 3) AS d, min(i) FILTER (m >= 6) AS s, max(i) AS seen FROM m GROUP BY 1)
SELECT user_id, CAST(coalesce(d, least(seen, 20)) AS INTEGER) AS decided_at, CASE WHEN s = d THEN 'SAME' WHEN d IS NOT NULL THEN 'DIFFERENT' ELSE 'UNKNOWN' END AS verdict FROM d""",
    "event_props": "SELECT event_type, count(*) AS n, count(k) AS with_k, CAST(sum(k) AS BIGINT) AS sum_k FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props) AND json_type(props) = 'OBJECT') GROUP BY 1",
    "event_presence": f"""WITH s AS (SELECT user_id, event_type, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(ts))) / 1e6 AS age FROM events GROUP BY 1, 2), r AS (SELECT user_id, CASE WHEN age > 345600 THEN 0 WHEN age > 86400 THEN 1 ELSE 2 END AS r FROM s)
SELECT user_id, CASE max(r) WHEN 2 THEN 'online' WHEN 1 THEN 'stale' ELSE 'offline' END AS state, count(*) FILTER (r > 0) AS live, count(*) FILTER (r > 0) > 1 AS split_brain FROM r GROUP BY 1""",
    "event_hours": f"SELECT strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H') AS local_hour, count(*) AS n, count(*) FILTER (ts > TIMESTAMP '{NOW}' - INTERVAL 3 DAY) AS recent FROM events GROUP BY 1",
    "event_report": """WITH c AS (SELECT user_id, CASE WHEN bool_or(event_type = 'signup') THEN 'passed' ELSE 'missing' END AS signed_up, CASE WHEN bool_or(event_type = 'purchase' AND value < 0) THEN 'failed' WHEN bool_or(event_type = 'purchase') THEN 'passed' ELSE 'missing' END AS bought,
  CASE WHEN bool_or(event_type = 'error' AND value > 30) THEN 'failed' WHEN bool_or(event_type = 'view') THEN 'passed' ELSE 'missing' END AS calm FROM events GROUP BY 1)
SELECT *, CASE WHEN signed_up = 'passed' AND bought = 'passed' AND calm = 'passed' THEN 'passed' WHEN 'failed' IN (signed_up, bought, calm) THEN 'failed' ELSE 'provisional' END AS status FROM c""",
    "event_autocorrelation": f"WITH {_AUTO} SELECT user_id, lag, round(rho, 6) AS rho FROM rho",
    "event_effective_size": f"""WITH {_AUTO}, p AS (SELECT *, min(CASE WHEN rho > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lag) AS ok FROM rho)
SELECT user_id, round(greatest(1.0, least(CAST(max(n) AS DOUBLE), max(n) / (1 + 2 * sum(CASE WHEN ok = 1 THEN rho ELSE 0 END)))), 4) AS ess FROM p GROUP BY 1""",
    "event_consensus": "SELECT user_id, event_type, c AS votes, CAST(n AS BIGINT) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, f) AS k FROM (SELECT user_id, event_type, count(*) AS c, min(event_id) AS f FROM events GROUP BY 1, 2)) WHERE k = 1",
    "event_wilson": f"""WITH h AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS hits, count(*) AS n FROM events GROUP BY 1), p AS (SELECT *, CAST(hits AS DOUBLE) / n AS p FROM h)
SELECT user_id, hits, n, round(greatest(0.0, (p + {_Z} * {_Z} / (2 * n) - {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4.0 * n * n))) / (1 + {_Z} * {_Z} / n)), 6) AS low,
  round(least(1.0, (p + {_Z} * {_Z} / (2 * n) + {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4.0 * n * n))) / (1 + {_Z} * {_Z} / n)), 6) AS high, round(1 - pow(0.05, 1.0 / n), 6) AS zero_bound, round(1 - pow(1 - p, 3), 6) AS any_of_3 FROM p""",
    "event_thresholds": f"""WITH c AS (SELECT user_id, count(*) FILTER (event_type IN ('error', 'click')) AS m FROM (SELECT *, row_number() OVER ({_S}) AS k FROM events) WHERE k <= 10 GROUP BY 1),
g AS (SELECT CAST(a.k AS INTEGER) AS k_different, CAST(b.k AS INTEGER) AS k_same FROM (SELECT unnest(range(0, 10)) AS k) a, (SELECT unnest(range(1, 11)) AS k) b WHERE a.k < b.k),
v AS (SELECT *, CASE WHEN m >= k_same THEN 'SAME' WHEN m <= k_different THEN 'DIFFERENT' ELSE 'UNKNOWN' END AS v FROM c, g)
SELECT k_different, k_same, count(*) FILTER (v = 'SAME' AND user_id % 2 <> 0) AS false_same, count(*) FILTER (v = 'DIFFERENT' AND user_id % 2 = 0) AS false_different, count(*) FILTER (v = 'UNKNOWN') AS unknown, count(*) AS trials FROM v GROUP BY 1, 2""",
    "event_indicators": "SELECT event_id AS query_id, CAST(round(value * 100) AS BIGINT) IN (SELECT CAST(round(value * 100) AS BIGINT) FROM events WHERE event_type = 'signup') AS hit FROM events WHERE event_type = 'purchase'",
    "event_percentiles": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.1), 6) AS p10, round(avg(CASE WHEN value < 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS low_share FROM events GROUP BY 1",
    "event_pulses": """WITH h AS (SELECT event_id, CAST(round(abs(value) * 100) AS BIGINT) AS ms FROM events)
SELECT event_id, 0.0::DOUBLE AS pulse_ms FROM h UNION ALL SELECT event_id, CAST(unnest(range(500, ms + 1, 250)) AS DOUBLE) FROM h WHERE ms >= 500""",
    "label_grid": f"WITH {_LABELS} SELECT recording_id, frame_index FROM (SELECT *, min(frame_index) OVER (PARTITION BY recording_id) AS f FROM labels) WHERE (frame_index - f) % 30 = 0",
    "label_consensus": f"WITH {_LABELS} SELECT recording_id, kind, c AS votes, CAST(n AS BIGINT) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY recording_id) AS n, row_number() OVER (PARTITION BY recording_id ORDER BY c DESC, f) AS k FROM (SELECT recording_id, kind, count(*) AS c, min(frame_index) AS f FROM labels GROUP BY 1, 2)) WHERE k = 1",
    "label_transitions": f"WITH {_LABELS} SELECT p AS from_state, kind AS to_state, count(*) AS n FROM (SELECT *, lag(kind) OVER (PARTITION BY recording_id ORDER BY frame_index) AS p FROM labels) WHERE p IS NOT NULL GROUP BY 1, 2",
    "outbox_last_state": "SELECT outbox_id, status, updated_at, events FROM (SELECT *, count(*) OVER (PARTITION BY outbox_id) AS events, row_number() OVER (PARTITION BY outbox_id ORDER BY updated_at DESC NULLS LAST, delivery_row_id DESC) AS k FROM delivery_outbox) WHERE k = 1",
    "outbox_replays": f"WITH {_replays('delivered_at, delivery_row_id')} SELECT delivery_row_id, outcome FROM outcomes",
    "outbox_heartbeats": f"WITH {_replays('epoch_us(delivered_at) * 1000 + delivery_row_id % 1000')} SELECT scan_session_id, outcome, count(*) AS n FROM outcomes GROUP BY 1, 2",
    "event_cadence": """WITH RECURSIVE a AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1
  UNION ALL SELECT e.user_id, min(e.ts) FROM a JOIN events e ON e.user_id = a.user_id AND e.ts >= a.ts + INTERVAL 1 DAY GROUP BY e.user_id)
SELECT a.user_id, min(event_id) AS event_id FROM a JOIN events e ON e.user_id = a.user_id AND e.ts = a.ts GROUP BY a.user_id, a.ts""",
    "outbox_conflicts": "SELECT *, CASE WHEN digests > 1 THEN 'CONFLICT' WHEN deliveries > 1 THEN 'REPLAY' ELSE 'FIRST' END AS outcome FROM (SELECT scan_session_id, idempotency_key, count(*) AS deliveries, count(DISTINCT upload_digest) AS digests FROM delivery_outbox WHERE idempotency_key IS NOT NULL GROUP BY 1, 2)",
    "outbox_gapless": "SELECT scan_session_id, count(DISTINCT sequence) AS n, min(sequence) AS \"first\", max(sequence) AS \"last\", min(sequence) = 1 AND count(DISTINCT sequence) = max(sequence) AS complete FROM delivery_outbox GROUP BY 1",
    "outbox_cutoff": "SELECT o.scan_session_id, count(*) FILTER (through IS NULL OR sequence <= through) AS accepted, count(*) FILTER (NOT (through IS NULL OR sequence <= through)) AS late FROM delivery_outbox o LEFT JOIN (SELECT scan_session_id, max(sequence) AS through FROM scan_spreads GROUP BY 1) c USING (scan_session_id) GROUP BY 1",
    "outbox_flush": "SELECT scan_session_id, CASE WHEN bool_or(status = 'rejected') THEN 'BLOCKED' WHEN count(DISTINCT sequence) FILTER (status = 'acked') >= max(sequence) THEN 'FLUSHED' ELSE 'PENDING' END AS state, max(sequence) - count(DISTINCT sequence) FILTER (status = 'acked') AS missing FROM delivery_outbox WHERE sequence >= 1 GROUP BY 1",
    "outbox_retries": "SELECT delivery_row_id, delay, round(delay * (1 + (2 * ((delivery_row_id % 100) / 100.0::DOUBLE) - 1) * 0.2::DOUBLE), 6) AS jittered FROM (SELECT delivery_row_id, least(60.0::DOUBLE, pow(2.0::DOUBLE, greatest(coalesce(attempt_count, 0) - 1, 0))) AS delay FROM delivery_outbox WHERE status = 'retrying')",
    "outbox_leases": "SELECT lease, count(*) AS n FROM (SELECT CASE WHEN status <> 'sending' OR updated_at IS NULL THEN 'free' WHEN updated_at + INTERVAL 300 SECOND > TIMESTAMP '2026-06-01 00:00:00' THEN 'live' WHEN attempt_count >= 3 THEN 'exhausted' ELSE 'queued' END AS lease FROM delivery_outbox) GROUP BY 1",
    "outbox_bytes": "SELECT scan_session_id, CAST(coalesce(sum(m), 0) AS BIGINT) AS total FROM (SELECT scan_session_id, outbox_id, max(total_file_bytes) AS m FROM delivery_outbox GROUP BY 1, 2) GROUP BY 1",
    "outbox_counts": "SELECT count(*) AS n, count(*) FILTER (status = 'acked') AS acked, count(last_error_code) AS errors, CAST(coalesce(sum(total_file_bytes) FILTER (status = 'acked'), 0) AS BIGINT) AS acked_bytes FROM delivery_outbox",
    "outbox_digests": "SELECT DISTINCT outbox_id, 'pg-' || left(sha256(scan_session_id), 12) || '-' || lpad(CAST(sequence AS VARCHAR), 8, '0') || '-L' AS page_key, left(sha256(artifact_id || chr(0) || spread_id), 32) AS receipt, left(sha256(outbox_id), 16) AS text_key, sequence AS seq, 'L' AS side FROM delivery_outbox",
    "spread_counts": "SELECT s.status, coalesce(n, 0) AS n FROM (SELECT unnest(['received', 'processing', 'ready', 'rejected', 'error', 'sealed']) AS status) s LEFT JOIN (SELECT status, count(*) AS n FROM scan_spreads GROUP BY 1) USING (status)",
    "spread_rollup": "SELECT scan_session_id, count(*) AS n, CASE WHEN bool_or(status = 'rejected') THEN 'rejected' WHEN bool_or(status = 'error') THEN 'error' WHEN bool_and(status = 'ready') THEN 'ready' ELSE 'processing' END AS status FROM scan_spreads GROUP BY 1",
    "spread_queue": """SELECT * FROM (SELECT scan_session_id, sequence, artifact_id, CASE WHEN status = 'received' THEN 0 ELSE 1 END AS rank, min(received_at) AS received_at FROM scan_spreads WHERE status IN ('received', 'processing') GROUP BY 1, 2, 3, 4)
JOIN (SELECT scan_session_id, count(DISTINCT outbox_id) AS messages FROM delivery_outbox GROUP BY 1) USING (scan_session_id) ORDER BY rank, received_at, scan_session_id, sequence, artifact_id LIMIT 20""",
    "spread_nested": "SELECT p.scan_session_id, CAST(count(s.scan_session_id) AS INTEGER) AS n, arg_min(s.artifact_id, (s.sequence, s.artifact_id)) AS first_artifact FROM (SELECT DISTINCT scan_session_id FROM delivery_outbox) p LEFT JOIN scan_spreads s USING (scan_session_id) GROUP BY 1",
    "spread_orphans": "SELECT DISTINCT receipt_id, artifact_id, status FROM scan_spreads s WHERE received_at <= TIMESTAMP '2026-07-01 00:00:00' AND NOT EXISTS (SELECT 1 FROM delivery_outbox o WHERE o.status = 'acked' AND o.receipt_id = s.receipt_id)",
    "spread_catalog": "SELECT scan_session_id, updated_at, spreads, CAST(greatest(0, least(40, spreads - 1)) AS INTEGER) AS selected FROM (SELECT scan_session_id, max(updated_at) AS updated_at, count(DISTINCT sequence) AS spreads FROM scan_spreads GROUP BY 1) ORDER BY updated_at DESC, scan_session_id LIMIT 32",
    "spread_revisions": """WITH s AS (SELECT scan_session_id, sequence, max(receipt_id) AS receipt_id FROM scan_spreads WHERE receipt_id IS NOT NULL GROUP BY 1, 2)
SELECT concat_ws('/', s.scan_session_id, s.sequence) AS spread, s.receipt_id, max(attempt_count) AS attempts, count(*) AS deliveries FROM s JOIN delivery_outbox o
  ON concat_ws('/', s.scan_session_id, s.sequence) = concat_ws('/', o.scan_session_id, o.sequence) AND o.receipt_id = s.receipt_id GROUP BY 1, 2""",
}

QUERIES = {
    q.__name__: q
    for q in (
        event_scopes, event_runs, event_token_runs, event_changes, event_stability, event_pair_stability, event_best, event_ring, event_window_drops, event_neighbours, event_transitions, event_only_changes, event_holds,
        event_decisions, event_props, event_presence, event_hours, event_report, event_autocorrelation, event_effective_size, event_bootstrap, event_consensus, event_wilson, event_thresholds, event_indicators,
        event_percentiles, event_cadence, event_pulses, label_grid, label_consensus, label_transitions, outbox_last_state, outbox_conflicts, outbox_replays, outbox_gapless, outbox_cutoff, outbox_flush, outbox_retries,
        outbox_leases, outbox_bytes, outbox_counts, outbox_digests, outbox_canonical, spread_counts, spread_rollup, spread_queue, spread_nested, spread_orphans, spread_revisions, spread_catalog,
        frame_page_changes, frame_verdicts, frame_checks, frame_guidance, frame_ledger, frame_pulses, frame_fused_changes, outbox_heartbeats,
    )
}
