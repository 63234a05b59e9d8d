"""Failure storms over a finished log: blocks of a service become maps from entry state to exit state.

A long run of successes after a failure ends any outage, whatever came before: such a place is a
*border*.  What is known at a border is small: how many failures of the current calm count (none to one
less than the threshold; their times are those of the latest failures), and how many outages there were,
up to the number at which pauses stop growing.  So the stretch between two borders is a map over few
states, found for every stretch on its own; a service's maps are chained, and every stretch is
then worked through once with the state it is really entered in.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ordered as o
from ..session import cut_lineage
from .machines import STORM_OUT, Outage, StormRules, outage_timeline, storm_rows

#: Rows of a block; every block has one border at most.
BLOCK_ROWS = 1 << 16


def grown(rules: StormRules) -> int:
    """Outages after which the first pause grows no more."""
    return max(0, -(-(60 - rules.initial_pause) // 15))


def border(times: np.ndarray, failed: np.ndarray, rules: StormRules) -> int | None:
    """Index of the first success by which every outage of these answers' past has ended.

    After a failure an outage's pause ends within 60 seconds, or a probe interval after the
    last success before it.  From the first success after that, as many steps as
    successes are asked for (each at least a probe interval long, and enough of them for the recovery
    time) end it, if no failure comes between.  An earlier pause's end makes every step earlier.
    """
    fails = np.flatnonzero(failed)
    if not len(fails):
        return None
    ends = np.append(fails[1:], len(times))
    at = np.maximum(np.searchsorted(times, times[fails] + max(60.0, rules.probe_interval)), fails + 1)
    begun = at
    if rules.probe_interval > 0:
        steps = max(rules.successes - 1, int(-(-rules.recovery_min // rules.probe_interval)))
        for _ in range(steps):
            ahead = np.searchsorted(times, times[np.minimum(at, len(times) - 1)] + rules.probe_interval)
            at = np.where(at < ends, np.maximum(ahead, at + 1), at)
    else:
        late = np.searchsorted(times, times[np.minimum(begun, len(times) - 1)] + rules.recovery_min)
        at = np.maximum(begun + rules.successes - 1, late)
    good = np.flatnonzero((begun < ends) & (at < ends))
    return int(at[good[0]]) if len(good) else None


def _rules(settings: dict[str, dict] | None, defaults: dict):
    named = {name: StormRules(**{**defaults, **own}) for name, own in (settings or {}).items()}
    common = StormRules(**defaults)
    return lambda service: named.get(service, common)


def detect_storms_batch(calls: DataFrame, settings: dict[str, dict] | None = None, block_rows: int = BLOCK_ROWS, **defaults) -> DataFrame:
    """The rows of :func:`~cuelog.streaming.machines.detect_storms` for a table: service, ts (seconds), seq, kind.

    Borders are looked for in blocks of ``block_rows`` rows; a service is split at them, so a
    service with most of the rows is the work of many tasks.  (A service that never recovers has no border
    and stays one stretch.)  Rows with another kind, or without a time, are left out; rows without a service
    are one service.
    """
    rules_of = _rules(settings, defaults)
    narrow = calls.select(F.coalesce(F.concat(F.lit(":"), F.col("service").cast("string")), F.lit("")).alias("_key"), "ts", "seq", "kind")
    narrow = narrow.filter("ts IS NOT NULL AND kind IN ('failure', 'success', 'request')")
    rows = cut_lineage(o.ordered_scan(narrow, ["_key"], ["ts", "seq"], o.every("ts", 86400), _pos=o.row_number()))
    name = lambda key: key[1:] if key else None

    def look(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        rules = rules_of(name(key[0]))
        part = part[part["kind"] != "request"].sort_values("_pos")
        times, failed, pos = part["ts"].to_numpy(float), (part["kind"] == "failure").to_numpy(), part["_pos"].to_numpy()
        at = border(times, failed, rules) if len(part) else None
        lag, cut = rules.threshold - 1, len(part) if at is None else at + 1
        last = lambda a, b: times[a:b][failed[a:b]][max(0, int(failed[a:b].sum()) - lag):].tolist() if lag else []
        return pd.DataFrame({"_key": [key[0]], "_block": [key[1]], "border": [None if at is None else int(pos[at])], "before": [last(0, cut)], "after": [last(cut, len(part))]}).astype({"border": "Int64"})

    block = F.floor((F.col("_pos") - 1) / block_rows).cast("bigint").alias("_block")
    looked = cut_lineage(rows.select("*", block).groupBy("_key", "_block").applyInPandas(look, "_key string, _block bigint, border bigint, before array<double>, after array<double>"))

    def number(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        """Stretches of a service, and the latest failures before each."""
        lag, stretch, tail, out = rules_of(name(key[0])).threshold - 1, 0, [], []
        keep = lambda x: x[max(0, len(x) - lag):] if lag else []
        for b, at, before, after in part.sort_values("_block")[["_block", "border", "before", "after"]].itertuples(index=False):
            tail = keep(tail + list(before))
            out.append((key[0], b, stretch, at, tail))
            stretch += not pd.isna(at)
            tail = keep(tail + list(after))
        return pd.DataFrame(out, columns=["_key", "_block", "stretch", "border", "tail"]).astype({"border": "Int64"})

    blocks = cut_lineage(looked.groupBy("_key").applyInPandas(number, "_key string, _block bigint, stretch bigint, border bigint, tail array<double>"))
    entered = blocks.filter("border IS NOT NULL").select("_key", (F.col("stretch") + 1).alias("stretch"), "tail")
    placed = rows.select("*", block).join(blocks.drop("tail"), ["_key", "_block"])
    # The answer at the border still belongs to the stretch that it ends.
    placed = placed.select("_key", "ts", "seq", "kind", "_pos", (F.col("stretch") + F.coalesce((F.col("_pos") > F.col("border")).cast("int"), F.lit(0))).alias("stretch"))

    def memory_of(tail: list[float], state: int, rules: StormRules) -> Outage:
        kept, outages = divmod(state, grown(rules) + 1)
        return Outage(list(tail[len(tail) - kept:]) if kept else [], outages)

    def answers_of(part: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        answers = part[part["kind"] != "request"]
        return answers, answers["ts"].to_numpy(float), (answers["kind"] == "failure").to_numpy()

    def summed(key: tuple, part: pd.DataFrame, tails: pd.DataFrame) -> pd.DataFrame:
        """The state after the stretch for every state before it; -1 where an outage goes on (the last stretch only)."""
        rules = rules_of(name(key[0]))
        _, times, failed = answers_of(part.sort_values("_pos"))
        tail = list(tails["tail"].iloc[0]) if len(tails) else []
        exits = []
        for state in range(rules.threshold * (grown(rules) + 1)):
            if state // (grown(rules) + 1) > len(tail):
                exits.append(-1)  # so many failures there are not
                continue
            memory = memory_of(tail, state, rules)
            outage_timeline(memory, times, failed, rules)
            exits.append(-1 if not np.isnan(memory.until) else len(memory.tail) * (grown(rules) + 1) + min(memory.outages, grown(rules)))
        return pd.DataFrame({"_key": [key[0]], "stretch": [key[1]], "exits": [exits]})

    stretches = placed.groupBy("_key", "stretch").cogroup(entered.groupBy("_key", "stretch"))
    maps = cut_lineage(stretches.applyInPandas(summed, "_key string, stretch bigint, exits array<int>"))

    def chain(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        state, out = 0, []
        for stretch, exits in part.sort_values("stretch")[["stretch", "exits"]].itertuples(index=False):
            out.append((key[0], stretch, state))
            state = int(exits[state])
        return pd.DataFrame(out, columns=["_key", "stretch", "state"])

    states = maps.groupBy("_key").applyInPandas(chain, "_key string, stretch bigint, state int")
    known = cut_lineage(states.join(entered, ["_key", "stretch"], "left"))

    def tell(key: tuple, part: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame([], columns=[c.split()[0] for c in STORM_OUT.split(", ")])
        service, part = name(key[0]), part.sort_values("_pos")
        rules, tail = rules_of(service), entry["tail"].iloc[0]
        memory = memory_of([] if tail is None else list(tail), int(entry["state"].iloc[0]), rules)
        answers, times, failed = answers_of(part)
        start = memory.until
        reports, pauses = outage_timeline(memory, times, failed, rules)
        return storm_rows(service, part, answers, reports, pauses, start, False)[0]

    return placed.groupBy("_key", "stretch").cogroup(known.groupBy("_key", "stretch")).applyInPandas(tell, STORM_OUT)
