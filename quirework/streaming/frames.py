"""Stateful operators over frame streams, each as a plain step function.

A step takes the key's state (a dict) and one row (a dict) and returns the output
rows of that row.  `batch` folds a key's rows in order with it; `stream` runs the
same step in Structured Streaming with the state kept by Spark, one state a key, in
the order of the rows within each micro-batch.  Both forms give equal rows for
input that arrives in order.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[dict, dict], list[dict]]


@dataclass(frozen=True)
class Stateful:
    """A step with the schema of its output (without the key) and the order of its rows.

    In a live stream (stream with live), a key that has had no row for quiet_ms of clock
    time gives the rows of on_quiet and its state is removed; otherwise it is kept.
    """

    step: Step
    schema: str
    order: tuple[str, ...]
    on_quiet: Callable[[dict], list[dict]] | None = None
    quiet_ms: int | None = None

    def _names(self) -> list[str]:
        return [part.split()[0] for part in self.schema.split(", ")]

    def batch(self, rows: DataFrame, key: str) -> DataFrame:
        """Fold each key's rows in order; rows without a key are left out.

        The rows pass in sorted batches and only the state is kept, so a key of any
        length needs no more memory than one batch.
        """
        names, step = [key, *self._names()], self.step
        placed = rows.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *self.order)

        def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, state = None, {}
            for part in batches:
                out = []
                for r in part.astype(object).where(part.notna(), None).to_dict("records"):
                    if r[key] != now:
                        now, state = r[key], {}
                    out += [{key: now, **o} for o in step(state, r)]
                yield pd.DataFrame(out, columns=names).astype(object)

        return placed.mapInPandas(fold, f"{key} {dict(rows.dtypes)[key]}, {self.schema}")

    def stream(self, rows: DataFrame, key: str, live: bool = False) -> DataFrame:
        """The same over a stream, live with timers of the clock, else as a replay; the state is JSON text, so it survives restarts and lost executors with the checkpoint."""
        timeout = GroupStateTimeout.ProcessingTimeTimeout if live and self.quiet_ms else GroupStateTimeout.NoTimeout
        return rows.groupBy(key).applyInPandasWithState(self.folded(key, live), f"{key} {dict(rows.dtypes)[key]}, {self.schema}", "state string", "append", timeout)

    def folded(self, key: str, live: bool) -> Callable:
        """The function that a stream applies to a key's rows of one micro-batch, or to its silence."""
        names, step, order, quiet, wait = [key, *self._names()], self.step, list(self.order), self.on_quiet, self.quiet_ms if live else None

        def fold(k: tuple, parts: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
            state = json.loads(kept.get[0]) if kept.exists else {}
            if kept.hasTimedOut:
                kept.remove()
                yield pd.DataFrame([{key: k[0], **o} for o in (quiet(state) if quiet else [])], columns=names).astype(object)
                return
            whole = pd.concat(list(parts))
            out = [{key: k[0], **o} for r in _records(whole, order) for o in step(state, r)]
            kept.update((json.dumps(state),))
            if wait:
                kept.setTimeoutDuration(wait)
            yield pd.DataFrame(out, columns=names).astype(object)

        return fold


def _records(part: pd.DataFrame, order: list[str]) -> list[dict]:
    part = part.sort_values(order, kind="stable")
    return part.astype(object).where(part.notna(), None).to_dict("records")


def cadence(interval: float) -> Stateful:
    """Rows (t, frame) a sampler accepts: the first, then the next one at least `interval` after each accepted one."""

    def step(state: dict, row: dict) -> list[dict]:
        if state.get("next") is not None and row["t"] < state["next"]:
            return []
        state["next"] = row["t"] + interval
        return [{"frame": int(row["frame"]), "t": float(row["t"])}]

    return Stateful(step, "frame long, t double", ("t", "frame"))


def page_change(needed: int = 3) -> Stateful:
    """Rows (t, frame, relation, eligible, armed): a change fires once, after `needed` frames that differ from the baseline and repeat each other.

    relation is CHANGED, SAME or, for a frame that repeats the candidate before it,
    REPEAT.  An ineligible frame drops the candidate; after firing nothing fires until
    a row arms the gate again.
    """

    def step(state: dict, row: dict) -> list[dict]:
        if row.get("armed"):
            state.update(count=0, latched=False)
        if state.get("latched"):
            return []
        if not row.get("eligible") or row["relation"] == "SAME":
            state["count"] = 0
            return []
        state["count"] = state.get("count", 0) + 1 if row["relation"] == "REPEAT" and state.get("count") else 1
        if state["count"] < needed:
            return []
        state.update(count=0, latched=True)
        return [{"frame": int(row["frame"]), "t": float(row["t"])}]

    return Stateful(step, "frame long, t double", ("t", "frame"))


def collector(n: int, k_same: int, k_different: int, timeout: float) -> Stateful:
    """Rows (t, frame, value, bank or banks): verdict on the values seen since the last one.

    Each bank holds the accepted values of one artifact (bank: an array of strings;
    banks: an array of those).  Without a bank the verdict is DIFFERENT once n values
    are in and one makes up more than half; with banks it is SAME as soon as k_same
    values are in one of them and DIFFERENT when n are in, at most k_different match
    any one bank and a majority agrees.  Past the time-out, and in a live stream after as
    long without a row, it is UNKNOWN.  Null values count for nothing.
    """

    def step(state: dict, row: dict) -> list[dict]:
        if state.get("start") is None:
            state.update(start=row["t"], seen=[])
        verdict = None
        if row["value"] is not None:
            state["seen"].append(row["value"])
            given = row["banks"] if row.get("banks") is not None else [row["bank"]] if row.get("bank") is not None else []
            banks = [set(b) for b in given if b is not None and len(b)]
            votes = max(state["seen"].count(v) for v in state["seen"])
            agreed = len(state["seen"]) >= n and votes >= n // 2 + 1
            hits = max((sum(v in b for v in state["seen"]) for b in banks), default=0)
            if banks and hits >= k_same:
                verdict = "SAME"
            elif agreed and (not banks or hits <= k_different):
                verdict = "DIFFERENT"
        if verdict is None and row["t"] - state["start"] >= timeout:
            verdict = "UNKNOWN"
        if verdict is None:
            return []
        out = {"frame": int(row["frame"]), "verdict": verdict, "samples": len(state["seen"])}
        state.update(start=None, seen=[])
        return [out]

    def quiet(state: dict) -> list[dict]:
        return [{"frame": None, "verdict": "UNKNOWN", "samples": len(state["seen"])}] if state.get("start") is not None else []

    return Stateful(step, "frame long, verdict string, samples int", ("t", "frame"), quiet, int(timeout * 1000))


def verification(burst: int = 5, audit_every: int = 4) -> Stateful:
    """Rows (t, frame, eligible, changed): when the expensive check runs and why.

    A visual change asks for up to `burst` checks in a row and then latches until the
    change is gone; without a change every audit_every-th eligible frame is checked.
    """

    def step(state: dict, row: dict) -> list[dict]:
        if not row.get("eligible"):
            state.update(burst=0, audit=0)
            return [{"frame": int(row["frame"]), "action": "skip", "reason": "INELIGIBLE"}]
        if row.get("changed"):
            state["audit"] = 0
            if state.get("burst", 0) >= burst:
                return [{"frame": int(row["frame"]), "action": "skip", "reason": "BURST_TIMEOUT"}]
            state["burst"] = state.get("burst", 0) + 1
            return [{"frame": int(row["frame"]), "action": "request", "reason": "BURST"}]
        state.update(burst=0, audit=state.get("audit", 0) + 1)
        if state["audit"] >= audit_every:
            state["audit"] = 0
            return [{"frame": int(row["frame"]), "action": "request", "reason": "AUDIT"}]
        return [{"frame": int(row["frame"]), "action": "skip", "reason": "UNCHANGED"}]

    return Stateful(step, "frame long, action string, reason string", ("t", "frame"))


def guidance(samples: int = 3, hold: float = 1.0, cool_down: float = 15.0) -> Stateful:
    """Rows (t, frame, reason): a reason is given once it has stood for enough samples and time, and not again within the cool-down."""

    def step(state: dict, row: dict) -> list[dict]:
        reason = row["reason"]
        if reason is None:
            state.update(reason=None, n=0)
            return []
        if reason != state.get("reason"):
            state.update(reason=reason, n=0, since=row["t"])
        state["n"] += 1
        last = state.get("last")
        if state["n"] < samples or row["t"] - state["since"] < hold or (last and last[0] == reason and row["t"] - last[1] < cool_down):
            return []
        state["last"] = [reason, row["t"]]
        return [{"frame": int(row["frame"]), "reason": reason}]

    return Stateful(step, "frame long, reason string", ("t", "frame"))


def heartbeat() -> Stateful:
    """Rows (arrival, sequence, digest): accepted, stale, replay or collision against the highest sequence so far; invalid without a sequence."""

    def step(state: dict, row: dict) -> list[dict]:
        if row["sequence"] is None:
            return [{"arrival": int(row["arrival"]), "sequence": None, "outcome": "invalid"}]
        s, d = int(row["sequence"]), row["digest"]
        if state.get("s") is None or s > state["s"]:
            state.update(s=s, d=d)
            outcome = "accepted"
        else:
            outcome = "stale" if s < state["s"] else "replay" if d == state["d"] else "collision"
        return [{"arrival": int(row["arrival"]), "sequence": s, "outcome": outcome}]

    return Stateful(step, "arrival long, sequence long, outcome string", ("arrival",))


def ledger(size: int = 32) -> Stateful:
    """Rows (t, frame, action, artifact): PUT makes an artifact pending, CONFIRM moves it into a ring of the last `size`; others do nothing.

    Each row gives the number of accepted artifacts and whether this one is among them.
    """

    def step(state: dict, row: dict) -> list[dict]:
        ring = state.setdefault("ring", [])
        if row["action"] == "PUT":
            state["pending"] = row["artifact"]
        elif row["action"] == "CONFIRM" and state.get("pending") == row["artifact"] and row["artifact"] is not None:
            if row["artifact"] not in ring:
                ring.append(row["artifact"])
            del ring[:-size]
            state["pending"] = None
        return [{"frame": int(row["frame"]), "held": len(ring), "known": row["artifact"] in ring}]

    return Stateful(step, "frame long, held int, known boolean", ("t", "frame"))


def pulses(delay: float = 0.5, interval: float = 0.25) -> Stateful:
    """Rows (t, frame, down): one pulse at the press; held for `delay`, one more at each row that is due, `interval` after the last."""

    def step(state: dict, row: dict) -> list[dict]:
        if not row["down"]:
            state["next"] = None
            return []
        if state.get("next") is None:
            state["next"] = row["t"] + delay
        elif row["t"] >= state["next"]:
            state["next"] = row["t"] + interval
        else:
            return []
        return [{"frame": int(row["frame"]), "t": float(row["t"])}]

    return Stateful(step, "frame long, t double", ("t", "frame"))


def fused_change(needed: int = 3) -> Stateful:
    """Rows (t, frame, relation, eligible, identity, numeric_differs): a page change is released when the identity says DIFFERENT and either the visual gate fired before or the printed numbers differ; SAME clears the visual evidence."""
    gate = page_change(needed).step

    def step(state: dict, row: dict) -> list[dict]:
        inner = state.setdefault("gate", {})
        if gate(inner, row):
            state["visual"] = True
        if row["identity"] == "SAME":
            state.update(visual=False, gate={})
        elif row["identity"] == "DIFFERENT" and (state.get("visual") or row.get("numeric_differs")):
            state.update(visual=False, gate={})
            return [{"frame": int(row["frame"]), "t": float(row["t"])}]
        return []

    return Stateful(step, "frame long, t double", ("t", "frame"))


def idempotent(events: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """A stream of events with one row a key, as long as copies come within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
