"""Split scans and greedy groups against plain loops, with blocks small enough to matter."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuelog.functions import ordered as o
from cuelog.functions.greedy import greedy_groups, island_groups
from cuelog.operators import pairs as pr
from cuelog.operators import segments as sg
from cuelog.operators import timeline as tl


def _rows(n, seed):
    rng = random.Random(seed)
    # key 0 holds more than half of all rows
    return [(rng.choice([0, 0, 0, 1, 2]), i, rng.choice([None, rng.randint(-5, 9)])) for i in range(n)]


def test_scans_equal_windows(spark):
    df = spark.createDataFrame(_rows(400, 1), "k int, i int, x int").repartition(5)
    x = F.col("x")
    got = o.ordered_scan(df, ["k"], ["i"], o.every("i", 7), n=o.row_number(), s=o.running_sum(x), sb=o.sum_before(x),
                         m=o.running_max(x), mb=o.max_before(x), p=o.previous(x), f=o.following(x),
                         lk=o.last_known(x), kb=o.known_before(x), nk=o.next_known(x))
    w = Window.partitionBy("k").orderBy("i")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    want = df.select(
        "k", "i", "x", F.row_number().over(w).alias("n"), F.coalesce(F.sum(x).over(upto), F.lit(0)).alias("s"),
        F.coalesce(F.sum(x).over(before), F.lit(0)).alias("sb"), F.max(x).over(upto).alias("m"), F.max(x).over(before).alias("mb"),
        F.lag(x).over(w).alias("p"), F.lead(x).over(w).alias("f"), F.last(x, True).over(upto).alias("lk"),
        F.last(x, True).over(before).alias("kb"), F.first(x, True).over(after).alias("nk"))
    assert sorted(map(tuple, got.select(want.columns).collect()), key=lambda r: r[:2]) == sorted(map(tuple, want.collect()), key=lambda r: r[:2])


def _naive_merge(rows, min_dur, max_gap, max_merged):
    out, cur = [], list(rows[0])
    for s, e in rows[1:]:
        if max(0, cur[1] - cur[0]) < min_dur and max(0, s - cur[1]) <= max_gap and max(cur[1], e) - cur[0] <= max_merged:
            cur[1] = max(cur[1], e)
        else:
            out.append(tuple(cur))
            cur = [s, e]
    return [*out, tuple(cur)]


def test_greedy_groups_cross_blocks(spark):
    rng = random.Random(5)
    data, want = [], {}
    for key, n in ((1, 300), (2, 40), (3, 1)):
        t, rows = 0.0, []
        for i in range(n):
            t += rng.choice([0, .125, .25, .5, .5, 1.0])
            rows.append((t, t + rng.choice([0, .125, .25, .5, 2.0])))
        data += [(key, i, s, e) for i, (s, e) in enumerate(rows)]
        want[key] = _naive_merge(rows, 1.5, .38, 5.8)

    def group_end(i, n, start, end):
        reach, j = end[i], i + 1
        while j < n and max(0, reach - start[i]) < 1.5 and max(0, start[j] - reach) <= .38 and max(reach, end[j]) - start[i] <= 5.8:
            reach, j = max(reach, end[j]), j + 1
        return j

    df = spark.createDataFrame(data, "media_id int, ord int, start double, end double").repartition(6)
    for rows, ahead in ((16, 16), (16, 1), (4, 2), (1000, 8)):
        grouped = greedy_groups(df, ["media_id"], ["start", "ord"], o.every("start", 10), ["start", "end"], group_end, block_rows=rows, look_ahead=ahead)
        got = grouped.groupBy("media_id", "group_start").agg(F.min("start").alias("s"), F.max("end").alias("e")).collect()
        for key in want:
            assert sorted((r.s, r.e) for r in got if r.media_id == key) == sorted(want[key])
        assert grouped.count() == len(data)


def test_group_longer_than_blocks(spark):
    data = [(1, i, 0.0, 0.25) for i in range(300)] + [(1, 300, 9.0, 9.5), (2, 0, 0.0, 1.0)]
    df = spark.createDataFrame(data, "media_id int, ord int, start double, end double").withColumn("text", F.lit("x"))

    def group_end(i, n, start, end):
        j = i + 1
        while j < n and start[j] - start[i] < 1:
            j += 1
        return j

    for rows, ahead in ((8, 1), (8, 4), (64, 300), (8192, 256)):
        got = greedy_groups(df, ["media_id"], ["start", "ord"], o.every("start", 10), ["start", "end"], group_end, block_rows=rows, look_ahead=ahead)
        assert sorted((r.media_id, r.group_start, r.n) for r in got.groupBy("media_id", "group_start").agg(F.count("text").alias("n")).collect()) == [(1, 1, 300), (1, 301, 1), (2, 1, 1)]


def test_merge_goldens(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 1.4, "a "), (1, 1, .5, 1.0, " b"), (2, 0, 0.0, 1.0, "x"), (2, 1, 3.0, 4.0, "y")],
                               "media_id int, ord int, start double, end double, text string")
    got = sorted((r.media_id, r.start, r.end, r.text) for r in sg.merge_short_segments(df, 1.5).collect())
    assert got == [(1, 0.0, 1.4, "a b"), (2, 0.0, 1.0, "x"), (2, 3.0, 4.0, "y")]


def test_packing(spark):
    sizes = [100, 3700, 50, 10, 10, 5000, 1] + [20] * 20
    df = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate(sizes)], "media_id int, seg_index int, source string")
    got = {r.seg_index: r.batch_no for r in pr.pack_batches(df).collect()}
    batch, count, chars, want = 1, 0, 0, {}
    for i, n in enumerate(sizes):
        if count and (count >= 8 or chars + n + 100 > 3900):
            batch, count, chars = batch + 1, 0, 0
        want[i], count, chars = batch, count + 1, chars + n + 100
    assert got == want


def test_pause_goldens(spark):
    media = spark.createDataFrame([(1, 10.0)], "media_id int, video_dur double")
    pauses = spark.createDataFrame([(1, 1, 2.0, .4, [1]), (1, 2, 2.2, .5, [2]), (1, 3, 4.0, .3, [3]), (1, 4, 5.0, .01, [4])],
                                   "media_id int, ord int, at double, duration double, segments array<bigint>")
    speech = spark.createDataFrame([(1, 0.0, 1.8), (1, 3.0, 3.8)], "media_id int, start double, end double")
    got = sorted((r["at"], round(r.duration, 6), r.segments) for r in tl.merge_nearby_pauses(pauses, speech, media).collect())
    assert got == [(2.2, .9, [1, 2]), (4.0, .3, [3])]
    # a boundary between the first two keeps them apart
    speech = spark.createDataFrame([(1, 2.1, 3.0)], "media_id int, start double, end double")
    assert tl.merge_nearby_pauses(pauses, speech, media).count() == 3


def test_slots_goldens(spark):
    rows = [(1, 0, 0.0, 1.0), (1, 1, 3.0, 4.0), (2, 0, 0.0, 3.0), (2, 1, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "media_id int, ord int, start double, end double")
    media = spark.createDataFrame([(1, 4.0), (2, 4.0)], "media_id int, video_dur double")
    got = {(r.media_id, r.ord): (r.spoken_slot, round(r.hard_slot, 6)) for r in sg.quality_slots(df, media).collect()}
    assert got[(1, 0)] == (1.0, 2.955) and got[(2, 0)] == (3.0, 0.0)


def test_circuit_pause_sum(spark):
    media = spark.createDataFrame([(1, 10.0, 25.0), (2, 10.0, None)], "media_id int, video_dur double, fps double")
    pauses = spark.createDataFrame([(m, .05 + i * .001) for m in (1, 2) for i in range(40)], "media_id int, duration double")
    got = {r.media_id: (round(r.effective_sec, 9), r.frames) for r in tl.quantize_pauses(pauses, media).collect()}
    raw = [.05 + i * .001 for i in range(40)]
    frames = sum(int(d * 25 + .5) for d in raw)
    assert got == {1: (round(frames / 25, 9), frames), 2: (round(sum(raw), 9), None)}


def _island_frame(spark, rows):
    frame = spark.createDataFrame(rows, "k string, s double, e double, t string")
    begin, advance = lambda s, e: (s, e), lambda state, s, e: None if s - state[1] > 1.0 or e - state[0] > 9.0 else (state[0], max(state[1], e))
    return island_groups(frame, ["k"], ["s", "e", "t"], o.every("s", 50), o.max_before(F.col("e")), lambda end: F.col("s") - end > 1.0, ["s", "e"], begin, advance)


def test_islands_against_a_loop(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), round(s, 2), round(s + rng.choice([0.1, 0.5, 2, 30]), 2), f"t{i}") for i, s in enumerate(rng.uniform(0, 900) for _ in range(700))]
    want = {}
    for k in "ab":
        first = reach = start = None
        for position, (_, s, e, t) in enumerate(sorted(r for r in rows if r[0] == k), 1):
            if first is None or s - reach > 1.0 or e - first > 9.0:
                first, reach, start = s, e, position
            reach = max(reach, e)
            want[t] = (position, start)
    got = _island_frame(spark, rows)
    assert got.columns == ["k", "s", "e", "t", "position", "group_start"]
    assert {r.t: (r.position, r.group_start) for r in got.collect()} == want
    assert _island_frame(spark, []).collect() == []


def test_a_long_group_is_one_pass(spark):
    """A group of 300,000 rows: no job while the plan is built, one step a row when it runs."""
    n = 300_000
    frame = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") / n).alias("pos"))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    made = island_groups(frame, ["k"], ["pos"], o.every("pos", 0.1), o.previous(F.col("pos")), lambda b: F.col("pos") - b >= 5, ["pos"],
                         lambda pos: (pos,), lambda state, pos: state if pos - state[0] < 5 else None)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    assert made.groupBy("group_start").count().collect() == [(1, n)]
