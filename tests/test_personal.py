"""Personal state in pieces, in streams and at the edges of a session."""

import random

import pytest
from pyspark.sql import functions as F

from lapwing.functions import tuner
from lapwing.operators import personal as U
from lapwing.streaming import state as S


def events(n, seed, user=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        action = r.choice(["rate"] * 3 + ["click", "skip", "dwell"])
        label = r.choice(["mmr", "xquad", "calibrated", "serendipity", "other"]) if action == "rate" else r.choice(["a", "b", None])
        rows.append((user, i, i, action, r.random() if action == "rate" else 100 * r.random(), label))
    return rows


def plain(rows, draws=tuner.draw):
    """One event after the other, straight from the rules."""
    w, p = {"lambda": 0.5, "alpha": 0.5, "beta": 0.3}, {"dwell": 0.0, "skip": 0.0, "switches": 0, "total": 0}
    last, rated = None, 0
    for user, _, _, action, value, label in rows:
        if action == "rate":
            if label in ("mmr", "xquad"):
                target = w["lambda"] if value > 0.7 else 1 - w["lambda"] if value < 0.3 else draws(user, rated)
                w["lambda"] = 0.9 * w["lambda"] + 0.1 * target
            for name, key in (("calibrated", "alpha"), ("serendipity", "beta")):
                if label == name:
                    old = w[key]
                    w[key] = 0.9 * old + 0.1 * (min(1.0, old + 0.1) if value > 0.7 else max(0.0, old - 0.1) if value < 0.3 else old)
            rated += 1
            continue
        t = p["total"]
        if action == "dwell":
            p["dwell"] = (p["dwell"] * t + value) / (t + 1)
        elif action == "skip":
            p["skip"] = (p["skip"] * t + 1) / (t + 1)
        else:
            p["switches"] += last is not None and last[0] != label
            last = (label,)
        p["total"] += 1
        if p["total"] > 10:
            score = 0.4 * min(1, p["dwell"] / 60) + 0.3 * (1 - p["skip"]) + 0.3 * min(1, p["switches"] / p["total"] * 5)
            w = {"lambda": 1 - 0.6 * score, "alpha": 0.3 + 0.4 * score, "beta": 0.2 + 0.4 * score}
    return [w["lambda"], w["alpha"], w["beta"], min(1.0, 0.05 * rated), rated, p["dwell"], p["skip"], p["switches"], p["total"]]


def state_of(rows, cuts):
    state, total, rated, last = tuner.start(), 0, 0, None
    for start, stop in zip([0, *cuts], [*cuts, len(rows)]):
        fold = tuner.Fold(1, total, rated, last)
        for _, _, _, action, value, label in rows[start:stop]:
            fold.add(action, value, label)
        state = tuner.resumed(state, fold.summary())
        total, rated, last = fold.total, fold.rated, fold.last
    return list(state.values())


@pytest.mark.parametrize("seed", range(12))
def test_pieces_join_to_the_whole(seed):
    rows = events(400, seed)
    if seed % 2:  # ratings alone: no interaction sets the weights anew
        rows = [x for x in rows if x[3] == "rate"]
    want = plain(rows)
    for cuts in ([], [1], [7, 8, 9], [100, 130], list(range(1, len(rows), 3))):
        assert state_of(rows, cuts) == pytest.approx(want, abs=1e-9)


def test_maps_stay_small_and_exact():
    r = random.Random(5)
    line, at = tuner.IDENTITY, [i / 50 for i in range(51)]
    values = list(at)
    for _ in range(20_000):
        good = r.random() < 0.5
        line, values = tuner.then_moved(line, good), [tuner.moved(v, good) for v in values]
    assert [tuner.value_at(line, x) for x in at] == pytest.approx(values, abs=1e-9) and len(line[0]) < 500


def test_hot_user_is_cut_and_the_result_stays(spark):
    rows = events(3000, 1) + [row for u in range(2, 30) for row in events(15, u, u)] + [(None, 1, 1, "click", 0.0, "a")]
    frame = spark.createDataFrame(rows, "user_id long, s long, event_id long, action string, value double, label string")
    frame = frame.withColumn("ts", F.timestamp_seconds("s")).withColumn("part", F.lit("clash")).repartition(7)
    got = {r[0]: list(r)[1:] for r in U.personal_state(frame).collect()}
    assert sorted(got) == list(range(1, 30))
    for user, state in got.items():
        assert state == pytest.approx(plain([x for x in rows if x[0] == user]), abs=1e-9)
    pieces = U.personal_state(frame)._jdf.queryExecution().toString().count("MapInArrow")
    small = U.personal_state(frame.limit(20))._jdf.queryExecution().toString().count("MapInArrow")
    assert pieces == small  # the plan does not grow with the longest user
    assert U.personal_state(frame.limit(0)).count() == 0


GAPS = [("2024-01-01 00:00:00", "2024-01-02 00:00:00", 1), ("2024-01-01 00:00:00", "2024-01-02 00:00:00.000001", 2), ("2024-01-01 00:00:00", "2024-01-02 00:00:00.000002", 2)]


def test_sessions_end_after_more_than_a_day(spark):
    rows = [(u, i, t, "click", i) for u, (a, b, _) in enumerate(GAPS) for i, t in enumerate((a, b))]
    frame = spark.createDataFrame(rows, "user_id long, event_id long, t string, action string, item_id long").withColumn("ts", F.to_timestamp("t"))
    got = {r["user_id"]: r["n"] for r in U.sessions(frame).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {u: n for u, (_, _, n) in enumerate(GAPS)}
    sizes = {u: 2 // n for u, (_, _, n) in enumerate(GAPS)}
    assert {r["user_id"]: r["n"] for r in U.session_history(frame).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).collect()} == sizes


def test_stream_folds_late_events_in_order(spark, tmp_path):
    """Events arrive in six files, out of order within the delay; seeds come back after a reset; a day of silence ends a session."""
    S.use_rocksdb(spark)
    hour = 3600
    r = random.Random(2)
    rows = [(1, s, i, r.choice(["click"] * 6 + ["seed"] * 3 + ["reset"]), r.randrange(8)) for i, s in enumerate(sorted(r.sample(range(20 * hour), 150)))]
    rows += [(u, 0, 1000 + u, "seed", 1) for u in range(5, 8)] + [(u, s, 2000 + u, "click", 2) for u, s in ((5, 24 * hour), (6, 24 * hour + 1), (7, 30 * hour))]
    rows.append((9, 60 * hour, 9999, "click", 1))
    schema = "user_id long, s long, event_id long, action string, item_id long"
    arrival = sorted(rows, key=lambda x: x[1] + r.randrange(50 * 60))
    for k in range(6):
        part = arrival[k * len(rows) // 6 : (k + 1) * len(rows) // 6]
        r.shuffle(part)
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds(F.col("s") + 10 * 24 * hour)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    arrived = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    S.run_to_table(S.session_stream(arrived, with_history=True), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert len([f for f in (tmp_path / "cp" / "commits").iterdir() if f.name.isdigit()]) >= 6
    got = {x["user_id"]: x for x in S.latest(spark, str(tmp_path / "out")).collect()}
    want = {}
    for x in U.session_history(source.where("user_id < 9")).orderBy("user_id", "ord").collect():
        want.setdefault(x["user_id"], []).append(x["item_id"])
    assert {u: x["history"] for u, x in got.items()} == want and 9 not in got
    assert want[5] == [1, 2] and want[6] == [2] and all(x["expired"] for x in got.values())
