"""Storms of finished logs against answers taken one by one."""

import random

import numpy as np
import pytest

from cuelog.streaming import machines as mc
from cuelog.streaming import storms

RULES = [mc.StormRules(), mc.StormRules(3, 120, 30, 3, 30, 15), mc.StormRules(4, 120, 30, 2, 10), mc.StormRules(2, 50, 5, 1, 0), mc.StormRules(1, 10, 60, 2, 5, 3), mc.StormRules(3, 60, 1, 4, 100, 7)]


class Guard:
    """One answer or request at a time."""

    def __init__(self, rules):
        self.r, self.fails, self.act, self.n = rules, [], False, 0
        self.asked = False

    def take(self, t, kind):
        r = self.r
        if kind == "request":
            if not self.act:
                return ("request", "normal")
            if t < self.until or self.asked:
                return ("request", "bypass")
            self.asked = True
            return ("request", "probe")
        self.asked = False
        if kind == "failure":
            self.fails.append(t)
            if not self.act:
                if len(self.fails) >= r.threshold and t - self.fails[-r.threshold] <= r.window_sec:
                    self.n, self.act, self.began, self.rounds, self.held, self.good = self.n + 1, True, t, 1, 0, []
                    self.until = t + min(60, r.initial_pause + (self.n - 1) * 15)
                    return ("started", self.until - t, 1)
                return None
            self.held, self.good = self.held + 1, []
            if t >= self.until:
                self.rounds += 1
                self.until = t + min(60, r.initial_pause + (self.rounds - 1) * 15)
                return ("extended", self.until - t, self.rounds)
            return None
        if not self.act or t < self.until:
            return None
        self.good.append(t)
        if len(self.good) >= r.successes and t - self.good[0] >= r.recovery_min:
            self.act, self.fails = False, []
            return ("finished", self.held, self.rounds, round(t - self.began, 3))
        if r.probe_interval > 0:
            self.until = t + r.probe_interval
        return None


def _log(rng, n, step):
    t, bad, out = 0.0, False, []
    for k in range(n):
        t += rng.choice(step)
        bad = bad if rng.random() < 0.9 else not bad
        kind = "request" if rng.random() < 0.3 else "failure" if rng.random() < (0.85 if bad else 0.1) else "success"
        out.append((t, k, kind))
    return out


def _told(row):
    if row.event == "request":
        return ("request", row.claim)
    if row.event == "finished":
        return ("finished", row.suppressed, row.rounds, row.duration_sec)
    return (row.event, row.pause_sec, row.rounds)


@pytest.mark.parametrize("failures", range(14))
def test_any_number_of_failures(failures):
    """A calm service with few or many failures in its first trigger."""
    for rules in RULES:
        times = np.arange(failures) * 1.0
        reports, _ = mc.outage_timeline(mc.Outage([]), times, np.ones(failures, bool), rules)
        assert [e["event"] for _, e in reports][:1] == (["started"] if failures >= rules.threshold and rules.threshold - 1 <= rules.window_sec else [])


def test_every_outage_ends_by_a_border():
    rng, found = random.Random(4), 0
    for rules in RULES:
        for _ in range(200):
            log = [x for x in _log(rng, 80, [0.0, 0.5, 2, 9, 31]) if x[2] != "request"]
            times, failed = np.array([x[0] for x in log]), np.array([x[2] == "failure" for x in log])
            at = storms.border(times, failed, rules)
            if at is None:
                continue
            found += 1
            assert not failed[at]
            for _ in range(6):
                memory = mc.Outage([], rng.randrange(3), times[0] + rng.choice([0, 1, 20, 59]), -5.0, rng.randrange(1, 4), 3, rng.choice([0, 1]), times[0] - 1)
                first = np.flatnonzero(failed)[0]
                memory.until = min(memory.until, times[first] + max(60.0, rules.probe_interval))
                mc.outage_timeline(memory, times[:at + 1], failed[:at + 1], rules)
                assert np.isnan(memory.until)
    assert found > 300


def test_batch_equals_steps(spark):
    rng, rows = random.Random(8), []
    names = [f"s{k}" for k in range(len(RULES))]
    for name in names:
        rows += [(name, *x) for x in _log(rng, 700, [0.0, 0.5, 2, 9, 31, 200])]
    rows += [(None, 1.0, 1, "request"), ("quiet", None, 2, "failure"), ("quiet", 3.0, 3, "other"), ("quiet", 4.0, 4, "success")]
    calls = spark.createDataFrame([(*r, "x") for r in rows], "service string, ts double, seq bigint, kind string, event string").repartition(4)
    settings = {name: rules.__dict__ for name, rules in zip(names, RULES)}
    want = []
    for name in [*names, None, "quiet"]:
        guard = Guard(dict(zip(names, RULES)).get(name, mc.StormRules()))
        for _, t, seq, kind in [r for r in rows if r[0] == name and r[1] is not None and r[3] != "other"]:
            said = guard.take(t, kind)
            if said:
                want.append((name, seq, said))
    for block_rows in (60, 1 << 16):
        got = storms.detect_storms_batch(calls, settings, block_rows).collect()
        assert sorted(((r.service, r.seq, _told(r)) for r in got), key=str) == sorted(want, key=str)
    assert storms.detect_storms_batch(calls.limit(0)).collect() == []
