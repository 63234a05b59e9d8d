"""Stateful operators: failure storms, provider circuit, stalls, occurrence sampling."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ordered as o
from ..functions.numbers import circuit_cooldown
from ..operators.events import SAMPLED_EVENTS, SAMPLE_POINTS

# ---- fixed values: storm settings per service ----
STORM_SETTINGS = {
    "google_translate": {"threshold": 6, "window_sec": 90, "successes": 3, "recovery_min": 10},
    "edge_tts": {"threshold": 3, "window_sec": 120, "successes": 3, "recovery_min": 30, "probe_interval": 15},
    "gtts": {"threshold": 4, "window_sec": 120, "successes": 2, "recovery_min": 10},
}
# ---- end of fixed values ----


@dataclass
class StormRules:
    threshold: int = 6
    window_sec: float = 90
    initial_pause: int = 30
    successes: int = 3
    recovery_min: float = 0
    probe_interval: float = 0


@dataclass
class Outage:
    """What is remembered of a service between triggers; ``until`` is NaN while it is calm."""
    tail: list[float]     # latest failures of the calm, one less than the threshold
    outages: int = 0
    until: float = float("nan")
    began: float = 0.0
    rounds: int = 0
    held: int = 0
    streak: int = 0       # successes in a row after the pause
    streak_from: float = 0.0
    asked: bool = False   # a probe is under way

    def pause(self, rules: StormRules, number: int) -> float:
        return float(min(60, rules.initial_pause + (number - 1) * 15))


def _next_from(times: np.ndarray, at: int, stop: int, moment: float) -> int:
    """First index in at..stop whose time is not before ``moment``."""
    return at + int(np.searchsorted(times[at:stop], moment, "left"))


def outage_timeline(memory: Outage, times: np.ndarray, failed: np.ndarray, rules: StormRules) -> tuple[list[tuple[int, dict]], list[tuple[int, float]]]:
    """Reports and pauses of a service's answers, in order; ``memory`` is carried on.

    A report is (answer, columns); a pause is (answer after which it holds, its end; NaN: calm).
    In the calm, an outage starts at the first failure that lies within the window of the
    one ``threshold - 1`` before it, a lag over failures alone.  In an outage, answers are
    taken in runs of one kind.  In a run of failures the pauses are extended by jumping
    to the first failure after each pause; in a run of successes those after the pause are
    counted the same way.
    """
    reports: list[tuple[int, dict]] = []
    pauses: list[tuple[int, float]] = []
    turns = np.append(np.flatnonzero(failed[1:] != failed[:-1]) + 1, len(times))
    lag, at = rules.threshold - 1, 0
    while at < len(times):
        if np.isnan(memory.until):
            fails = at + np.flatnonzero(failed[at:])
            seen = np.concatenate([np.array(memory.tail, float), times[fails]])
            dense = np.flatnonzero(seen[lag:] - seen[:max(0, len(seen) - lag)] <= rules.window_sec) + lag - len(memory.tail)
            dense = dense[dense >= 0]
            if not len(dense):
                memory.tail = seen[len(seen) - lag:].tolist() if 0 < lag <= len(seen) else (seen.tolist() if lag else [])
                break
            first = int(fails[dense[0]])
            began, number = float(times[first]), memory.outages + 1
            length = memory.pause(rules, number)
            memory.__dict__.update(Outage([], number, began + length, began, 1).__dict__)
            reports.append((first, {"event": "started", "pause_sec": length, "rounds": 1}))
            pauses.append((first, memory.until))
            at = first + 1
            continue
        stop = int(turns[np.searchsorted(turns, at, "right")])
        if failed[at]:
            memory.held += stop - at
            memory.streak = 0
            late = _next_from(times, at, stop, memory.until)
            while late < stop:
                memory.rounds += 1
                length = memory.pause(rules, memory.rounds)
                memory.until = float(times[late]) + length
                reports.append((late, {"event": "extended", "pause_sec": length, "rounds": memory.rounds}))
                pauses.append((late, memory.until))
                late = _next_from(times, late + 1, stop, memory.until)
            at = stop
            continue
        good = _next_from(times, at, stop, memory.until)
        at = stop
        while good < stop:
            now = float(times[good])
            memory.streak_from = memory.streak_from if memory.streak else now
            memory.streak += 1
            if memory.streak >= rules.successes and now - memory.streak_from >= rules.recovery_min:
                reports.append((good, {"event": "finished", "duration_sec": round(now - memory.began, 3), "suppressed": memory.held, "rounds": memory.rounds}))
                memory.__dict__.update(Outage([], memory.outages).__dict__)
                pauses.append((good, memory.until))
                at = good + 1
                break
            if rules.probe_interval > 0:
                memory.until = now + rules.probe_interval
                pauses.append((good, memory.until))
            good = _next_from(times, good + 1, stop, memory.until)
    return reports, pauses


def request_claims(answers_before: np.ndarray, times: np.ndarray, start: float, asked: bool, pauses: list[tuple[int, float]]) -> tuple[list[str], bool]:
    """What each request may do: ``normal`` in the calm, one ``probe`` after a pause for each answer, else ``bypass``.

    ``answers_before``: answers of the trigger before each request.  ``start`` and ``asked`` are
    the pause and probe the trigger begins with; the last value tells whether a probe of
    these requests came after the last answer.
    """
    ends = np.array([start, *(end for _, end in pauses)])
    until = ends[np.searchsorted([k for k, _ in pauses], answers_before, "left")] if len(times) else np.zeros(0)
    calm = np.isnan(until)
    open_for_probe = ~calm & (times >= np.nan_to_num(until)) & ~(asked & (answers_before == 0))
    _, first = np.unique(answers_before[open_for_probe], return_index=True)
    probes = np.flatnonzero(open_for_probe)[first]
    claims = np.where(calm, "normal", "bypass").astype(object)
    claims[probes] = "probe"
    return claims.tolist(), set(answers_before[probes].tolist())


STORM_STATE = ("tail array<double>, outages int, until double, began double, rounds int, held int, streak int, streak_from double, asked boolean")
STORM_OUT = "service string, ts double, seq bigint, event string, claim string, pause_sec double, duration_sec double, suppressed int, rounds int"


def storm_rows(service: str | None, rows: pd.DataFrame, answers: pd.DataFrame, reports: list, pauses: list, start: float, asked: bool) -> tuple[pd.DataFrame, bool]:
    """Reports and claims as rows, in the order of ``rows``; and whether a probe is under way after them."""
    asks = (rows["kind"] == "request").to_numpy()
    requests, before = rows[asks], np.cumsum(~asks)[asks]
    claims, probed = request_claims(before, requests["ts"].to_numpy(float), start, asked, pauses)
    told = answers.iloc[[k for k, _ in reports]][["ts", "seq"]].reset_index(drop=True).join(pd.DataFrame([r for _, r in reports]))
    said = requests[["ts", "seq"]].assign(event="request", claim=claims)
    out = pd.concat([told, said]).assign(service=service).reindex(columns=[c.split()[0] for c in STORM_OUT.split(", ")])
    # Texts as plain objects: pandas may hold joined text columns in several pieces.
    out = out.sort_values(["ts", "seq"]).astype({"service": object, "event": object, "claim": object, "suppressed": "Int32", "rounds": "Int32", "pause_sec": float, "duration_sec": float})
    return out, len(answers) in probed or (asked and not len(answers))


def detect_storms(calls: DataFrame, settings: dict[str, dict] | None = None, **defaults) -> DataFrame:
    """Outages per service: started, extended, finished; a claim for each request row.

    Streaming input: service, ts (seconds), seq, kind (failure, success, request).
    ``settings`` names rules per service, ``defaults`` those of all others.  Rows with
    another kind, or without a time, are left out.
    """
    rules = {name: StormRules(**{**defaults, **own}) for name, own in (settings or {}).items()}
    common = StormRules(**defaults)
    names = [part.split()[0] for part in STORM_STATE.split(", ")]

    def run(key, frames: Iterator[pd.DataFrame], group) -> Iterator[pd.DataFrame]:
        memory = Outage(**dict(zip(names, group.get))) if group.exists else Outage([])
        memory.tail = list(memory.tail)
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        answers = rows[rows["kind"] != "request"]
        start = memory.until
        reports, pauses = outage_timeline(memory, answers["ts"].to_numpy(float), (answers["kind"] == "failure").to_numpy(), rules.get(key[0], common))
        out, memory.asked = storm_rows(key[0], rows, answers, reports, pauses, start, memory.asked)
        group.update(tuple(getattr(memory, n) for n in names))
        yield out

    narrow = calls.select(F.col("service").cast("string").alias("service"), "ts", "seq", "kind").filter("ts IS NOT NULL AND kind IN ('failure', 'success', 'request')")
    return narrow.groupBy("service").applyInPandasWithState(run, STORM_OUT, STORM_STATE, "append", "NoTimeout")


# ---------------------------------------------------------------- provider circuit
def provider_circuit(calls: DataFrame, base_cooldown: float = 60.0) -> DataFrame:
    """Failure streak and cool-down per provider, as a batch.

    Input: provider, ts (seconds), seq, reason (NULL = success).  ``available``
    tells whether the provider could be asked when the row came.
    """
    order = ["ts", "seq"]
    rows = calls.withColumn("_day", o.every("ts", 86400)).withColumn("_r", F.coalesce("reason", F.lit("")))
    seen = o.ordered_scan(rows, ["provider"], order, "_day", _p=o.row_number(), _prev=o.previous(F.col("_r"), F.lit("")))
    change = (F.col("_r") == "") | (F.col("_r") != F.col("_prev"))
    runs = o.ordered_scan(seen, ["provider"], order, "_day", _from=o.last_known(F.when(change, F.col("_p"))),
                          _epoch=o.last_known(F.when(F.col("_r") == "", F.col("_p"))))
    streak = F.when(F.col("_r") == "", 0).otherwise(F.col("_p") - F.col("_from") + 1)
    runs = runs.withColumn("streak", streak).withColumn("_epoch", F.coalesce("_epoch", F.lit(0)))
    pause = F.when(F.col("_r") == "rate_limit", circuit_cooldown(F.lit(base_cooldown), "streak")).otherwise(base_cooldown)
    until = F.when(F.col("_r") != "", F.col("ts") + pause)
    held = o.ordered_scan(runs.withColumn("_until", until), ["provider", "_epoch"], order, "_day",
                          cooldown_until=o.running_max(F.col("_until")), _before=o.max_before(F.col("_until")))
    # a success ends the cool-down but was itself subject to the one before it
    prior = o.ordered_scan(held, ["provider"], order, "_day", _last=o.previous(F.col("cooldown_until")))
    return prior.select(
        "provider", "ts", "seq", "reason", "streak", F.coalesce("cooldown_until", F.lit(0.0)).alias("cooldown_until"),
        (F.coalesce("_last", F.lit(0.0)) <= F.col("ts")).alias("available"))


CIRCUIT_OUT = "provider string, ts double, seq bigint, reason string, streak int, cooldown_until double, available boolean"


def provider_circuit_stream(calls: DataFrame, base_cooldown: float = 60.0) -> DataFrame:
    """The same columns as :func:`provider_circuit`, kept up to date on a stream.

    A trigger's rows are worked on as columns, like the batch: runs of one reason give
    the streak, stretches between successes the largest end of a pause.  The last reason,
    its streak and the pause go on to the next trigger.
    """
    def run(key, frames, group) -> Iterator[pd.DataFrame]:
        reason, streak, until = group.get if group.exists else ("", 0, 0.0)
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"]).reset_index(drop=True)
        why = rows["reason"].where(rows["reason"].notna(), "").astype(str)
        good = why == ""
        runs = (why != why.shift(fill_value=reason)).cumsum()
        length = why.groupby(runs).cumcount() + 1 + (runs == 0) * streak
        length = length.where(~good, 0)
        pause = (base_cooldown * 2.0 ** (length - 1).clip(0, 4)).clip(upper=900.0).where(why == "rate_limit", base_cooldown)
        ends = (rows["ts"] + pause).where(~good, 0.0)
        stretch = good.cumsum()
        held = ends.groupby(stretch).cummax()
        held = held.where(stretch > 0, held.clip(lower=until)).where(~good, 0.0)
        free = held.shift(fill_value=until) <= rows["ts"]
        group.update((str(why.iloc[-1]), int(length.iloc[-1]), float(held.iloc[-1])))
        yield pd.DataFrame({"provider": key[0], "ts": rows["ts"], "seq": rows["seq"], "reason": rows["reason"].where(~good, None),
                            "streak": length.astype("int32"), "cooldown_until": held, "available": free})

    narrow = calls.select(F.col("provider").cast("string").alias("provider"), "ts", "seq", "reason")
    return narrow.groupBy("provider").applyInPandasWithState(
        run, CIRCUIT_OUT, "reason string, streak int, until double", "append", "NoTimeout")


# ---------------------------------------------------------------- stalls
def detect_stalls(events: DataFrame, stale_sec: int = 900) -> DataFrame:
    """Silences of at least ``stale_sec`` inside a session, as a batch."""
    ahead = o.ordered_scan(events, ["session_id"], ["sequence"], o.every("sequence", 50000), _next=o.following(F.col("ts")))
    gap = (F.unix_micros("_next") - F.unix_micros("ts")) / 1e6
    return (ahead.withColumn("gap_sec", gap).filter(F.col("gap_sec") >= stale_sec)
            .select("session_id", F.col("ts").alias("last_seen"), "gap_sec", F.lit("interrupted").alias("state")))


def detect_stalls_stream(events: DataFrame, stale_sec: int = 900, watermark: str = "10 minutes") -> DataFrame:
    """A row for each session that falls silent for ``stale_sec`` of event time."""
    def run(key, frames, group) -> Iterator[pd.DataFrame]:
        columns = ["session_id", "last_seen", "state"]
        if group.hasTimedOut:
            (last,) = group.get
            group.remove()
            yield pd.DataFrame([(key[0], pd.Timestamp(last, unit="ms"), "interrupted")], columns=columns)
            return
        newest = max(int(frame["ts"].max().timestamp() * 1000) for frame in frames)
        if group.exists:
            newest = max(newest, group.get[0])
        group.update((newest,))
        group.setTimeoutTimestamp(max(newest + stale_sec * 1000, group.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([], columns=columns)

    narrow = events.select(F.col("session_id").cast("string").alias("session_id"), "ts").withWatermark("ts", watermark)
    return narrow.groupBy("session_id").applyInPandasWithState(
        run, "session_id string, last_seen timestamp, state string", "last_ms bigint", "append", "EventTimeTimeout")


# ---------------------------------------------------------------- sampling
SAMPLED_OUT = "session_id string, signature string, sequence bigint, occurrence bigint, stored boolean"


def sample_repeats_stream(events: DataFrame, ttl_ms: int | None = None, sampled: list[str] | None = None,
                          buckets: int = 4, groups: int = 1024) -> DataFrame:
    """Occurrence number and storage decision per event as it arrives.

    Input: session_id, signature, sequence, event.  A session's signatures are
    dealt over ``buckets``, so that a busy session is not the work of one task,
    and all buckets over ``groups`` keys, whose rows are numbered in one pass: a
    trigger calls Python once a key, however many sessions there are.  With
    ``ttl_ms`` a bucket unseen for so long is forgotten.
    """
    narrow = events.select(F.col("session_id").cast("string").alias("session_id"), "signature", "sequence", "event",
                           F.pmod(F.hash("signature"), F.lit(buckets)).alias("bucket"))
    # the length tells where the session ends and the signature begins
    session = F.concat(F.coalesce(F.length("session_id"), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce("session_id", F.lit("")))
    dealt = narrow.select(
        "session_id", "signature", "sequence", "event", F.concat(session, F.coalesce(F.concat(F.lit("="), "signature"), F.lit(""))).alias("key"),
        F.concat(F.col("bucket").cast("string"), F.lit(":"), session).alias("unit"),
        F.pmod(F.xxhash64("session_id", "bucket"), F.lit(groups)).cast("int").alias("group"))
    return dealt.groupBy("group").applyInPandasWithState(
        _repeat_sampler(set(sampled or SAMPLED_EVENTS), ttl_ms), SAMPLED_OUT, "repeats binary", "append",
        "ProcessingTimeTimeout" if ttl_ms else "NoTimeout")


def _repeat_sampler(chatty: set[str], ttl_ms: int | None):
    """The function of a group.

    Its state is an Arrow table: how often each key was seen and, with a time to live, when its unit was
    last seen.  What is known is only compared with the trigger's keys, never made into Python values.
    """
    kept = pa.schema([("key", pa.string()), ("n", pa.int64())] + ([("unit", pa.string()), ("seen", pa.int64())] if ttl_ms else []))

    def run(key, frames, group) -> Iterator[pd.DataFrame]:
        now = group.getCurrentProcessingTimeMs() if ttl_ms else 0
        known = pa.ipc.open_stream(group.get[0]).read_all() if group.exists else kept.empty_table()
        if not group.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values("sequence", kind="stable")
            code, first = pd.factorize(rows["key"])
            at = pc.index_in(known["key"], value_set=pa.array(first, pa.string())).to_numpy()  # NaN: not in this trigger
            again = np.flatnonzero(~np.isnan(at))
            place = at[again].astype(np.int64)
            counts, before = known["n"].to_numpy().copy(), np.zeros(len(first), np.int64)
            before[place] = counts[again]
            number = rows.groupby(code).cumcount() + 1 + before[code]
            total = before + np.bincount(code, minlength=len(first))
            counts[again] = total[place]
            new = np.ones(len(first), bool)
            new[place] = False
            columns = {"key": first[new], "n": total[new]}
            known = known.set_column(1, "n", pa.array(counts, pa.int64()))
            if ttl_ms:
                columns |= {"unit": rows["unit"][~rows["key"].duplicated()].to_numpy()[new], "seen": np.full(new.sum(), now)}
                met = pc.is_in(known["unit"], value_set=pa.array(rows["unit"].unique(), pa.string()))
                known = known.set_column(3, "seen", pc.if_else(met, now, known["seen"]))
            known = pa.concat_tables([known, pa.table([pa.array(columns[c.name], c.type) for c in kept], schema=kept)])
            keep = ~rows["event"].isin(chatty) | (number <= 3) | number.isin(SAMPLE_POINTS) | (number % 250 == 0)
            yield pd.DataFrame({"session_id": rows["session_id"], "signature": rows["signature"], "sequence": rows["sequence"],
                                "occurrence": number, "stored": keep})
        if ttl_ms:
            known = known.filter(pc.greater(known["seen"], now - ttl_ms))
            if not known.num_rows:
                group.remove()
                return
        group.update((_packed(known),))
        if ttl_ms:
            group.setTimeoutDuration(pc.min(known["seen"]).as_py() + ttl_ms - now)

    return run


def _packed(known: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, known.schema) as out:
        out.write_table(known.combine_chunks())
    return sink.getvalue().to_pybytes()
