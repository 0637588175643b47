"""Personal weights, sessions and sliders in batch form (the streaming twins live in lapwing.streaming)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lapwing.functions.ranking import positions, top_k
from lapwing.functions.tuner import DEFAULTS, MIN_INTERACTIONS, MIN_SHOWN, Fold, resumed, start  # noqa: F401
from lapwing.session import stage

PIECE = 10_000
# fixed values: presets of the styles
STYLES = {
    "accurate": (0.0, 0.0, 0.0, 0.0, 0.0),
    "explore": (0.9, 0.15, 0.05, 0.55, 0.25),
    "balanced": (0.5, 0.25, 0.25, 0.25, 0.25),
}
SLIDERS = ("main_diversity", "diversity", "calibration", "serendipity", "fairness")
WEIGHTS = ("diversity", "calibration", "serendipity", "fairness")


SUMMARY = (
    "user_id bigint, part int, total bigint, rated bigint, switches bigint, dwell array<double>, skip array<double>, weights_from array<double>, "
    "lam array<double>, alpha_x array<double>, alpha_y array<double>, beta_x array<double>, beta_y array<double>"
)
STATE = (
    "user_id bigint, lambda double, alpha double, beta double, confidence double, feedback_count bigint, "
    "avg_dwell_time double, skip_rate double, category_switches bigint, total_interactions bigint"
)
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    fields = [field.split() for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], ARROW[t]) for n, t in fields], names=[n for n, _ in fields])


def fold_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (part, user, time) to one summary for each user of a part; a piece may run over many batches."""
    key, fold, done = None, None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("part", "user_id", "action", "value", "label", "before")]
        for part, user, action, value, label, before in zip(*columns):
            if key != (part, user):
                if key is not None:
                    done.append({"user_id": key[1], "part": key[0], **fold.summary()})
                before = before or {"total": 0, "rated": 0, "last": None}
                key, fold = (part, user), Fold(user, before["total"], before["rated"], before["last"] and (before["last"]["label"],))
            fold.add(action, value, label)
        yield _batch(done, SUMMARY)
        done = []
    if key is not None:
        yield _batch([{"user_id": key[1], "part": key[0], **fold.summary()}], SUMMARY)


def join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries in order of (user, part) to the state of each user."""
    user, state, done = None, None, []
    for batch in batches:
        for s in batch.to_pylist():
            if user != s["user_id"]:
                if user is not None:
                    done.append({"user_id": user, **state})
                user, state = s["user_id"], start()
            state = resumed(state, s)
        yield _batch(done, STATE)
        done = []
    if user is not None:
        yield _batch([{"user_id": user, **state}], STATE)


def personal_state(events: DataFrame) -> DataFrame:
    """Weights, confidence and patterns of every user after all events, ratings and interactions in one order.

    `events`: user_id, ts, event_id, action (rate, dwell, skip, click), value (rating or seconds) and label (algorithm
    or category). Rows are dealt by range of (user, time), so a hot user is cut into pieces. Each piece starts with
    the counts and the last category before it (one small row for each part that begins inside a user) and becomes a
    summary; the few summaries of a user are then applied in order. Rows without a user are left out, a null rating is
    neutral, null seconds are 0.
    """
    order = ["user_id", "ts", "event_id"]
    value = F.coalesce("value", F.when(F.col("action") == "rate", float("nan")).otherwise(0.0)).cast("double")
    rows = events.where(F.col("user_id").isNotNull()).select(*order, "action", value.alias("value"), F.col("label").cast("string").alias("label"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stage(rows.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), F.col("user_id").cast("bigint").alias("user_id"), "action", "value", "label"), "actions")
    rated, clicked = F.col("action") == "rate", F.col("action") == "click"
    pieces = rows.groupBy("user_id", "part").agg(
        F.count_if(~rated).alias("t"), F.count_if(rated).alias("n"), F.max_by(F.when(clicked, F.struct("label")), F.when(clicked, F.col("at"))).alias("l")
    )
    earlier = W.partitionBy("user_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = F.struct(F.sum("t").over(earlier).alias("total"), F.sum("n").over(earlier).alias("rated"), F.last("l", ignorenulls=True).over(earlier).alias("last"))
    # only the first user of a part can have earlier pieces: no more rows than parts
    cut = pieces.select("user_id", "part", before.alias("before")).where(F.col("before.total").isNotNull())
    joined = rows.join(F.broadcast(cut), ["user_id", "part"], "left").repartition("part").sortWithinPartitions("part", "at")
    folded = joined.select("part", "user_id", "action", "value", "label", "before").mapInArrow(fold_pieces, SUMMARY)
    return folded.repartition("user_id").sortWithinPartitions("user_id", "part").mapInArrow(join_pieces, STATE)


def rating_events(feedback: DataFrame) -> DataFrame:
    return feedback.select("user_id", "ts", "event_id", F.lit("rate").alias("action"), F.col("rating").cast("double").alias("value"), F.col("algorithm").alias("label"))


def action_events(actions: DataFrame) -> DataFrame:
    return actions.select("user_id", "ts", "event_id", "action", F.col("dwell_time").cast("double").alias("value"), F.col("category").alias("label"))


def feedback_weights(feedback: DataFrame) -> DataFrame:
    """Final weights per user from ordered feedback (user_id, ts, event_id, algorithm, rating)."""
    return personal_state(rating_events(feedback)).select("user_id", "lambda", "alpha", "beta", "confidence", "feedback_count")


def _affine(rows: DataFrame, action: str, x: Column, name: str) -> DataFrame:
    """Running mean a' = (a*t + x)/(t+1) over the rows of one action, t = earlier interactions of any kind.

    Each step is an affine map of a, and affine maps compose: pieces of a user fold independently to one map
    (m, b) and the few maps of a user fold in order, starting at 0.
    """
    t = F.col("pos").cast("double")
    step = F.struct("pos", (t / (t + 1)).alias("m"), (x / (t + 1)).alias("b"))
    piece = F.floor(F.col("pos") / PIECE)
    one = F.struct(F.lit(1.0).alias("m"), F.lit(0.0).alias("b"))
    then = lambda acc, s: F.struct((acc["m"] * s["m"]).alias("m"), (acc["b"] * s["m"] + s["b"]).alias("b"))
    maps = rows.where(F.col("action") == action).groupBy("user_id", piece.alias("piece")).agg(F.sort_array(F.collect_list(step)).alias("s"))
    maps = maps.select("user_id", "piece", F.aggregate("s", one, then).alias("f"))
    whole = maps.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("piece", F.col("f.m").alias("m"), F.col("f.b").alias("b")))).alias("s"))
    return whole.select("user_id", F.aggregate("s", F.lit(0.0), lambda acc, s: acc * s["m"] + s["b"]).alias(name))


def interaction_patterns(actions: DataFrame) -> DataFrame:
    """Per user: running dwell mean, skip rate, category switches and total (user_id, ts, event_id, action,
    dwell_time, category). Switches compare each click with the user's previous click."""
    order = [F.col("ts"), F.col("event_id")]
    hour = F.date_trunc("hour", "ts")
    rows = positions(actions, ["user_id"], hour, order)
    totals = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_interactions"))
    dwell = _affine(rows, "dwell", F.col("dwell_time"), "avg_dwell_time")
    skips = _affine(rows, "skip", F.lit(1.0), "skip_rate")
    clicks = positions(actions.where(F.col("action") == "click"), ["user_id"], hour, order).select("user_id", "pos", "category")
    before = clicks.select("user_id", (F.col("pos") + 1).alias("pos"), F.col("category").alias("_prev"))
    changed = clicks.join(before, ["user_id", "pos"]).where(~F.col("category").eqNullSafe(F.col("_prev")))
    switches = changed.groupBy("user_id").agg(F.count(F.lit(1)).alias("category_switches"))
    out = totals.join(dwell, "user_id", "left").join(skips, "user_id", "left").join(switches, "user_id", "left")
    return out.fillna(0)


def preference(patterns: DataFrame) -> DataFrame:
    """Diversity preference (neutral .5 up to 10 interactions) and the weights it implies (null until then)."""
    dwell = F.least(F.lit(1.0), F.col("avg_dwell_time") / 60.0)
    switch = F.least(F.lit(1.0), F.col("category_switches") / F.col("total_interactions") * 5)
    score = 0.4 * dwell + 0.3 * (1 - F.col("skip_rate")) + 0.3 * switch
    enough = F.col("total_interactions") > MIN_INTERACTIONS
    rows = patterns.withColumn("preference", F.when(enough, score).otherwise(0.5))
    p = F.col("preference")
    return rows.select(
        "*",
        F.when(enough, 1.0 - p * 0.6).alias("lambda"),
        F.when(enough, 0.3 + p * 0.4).alias("alpha"),
        F.when(enough, 0.2 + p * 0.4).alias("beta"),
    )


def reader_label(patterns: DataFrame) -> DataFrame:
    """Explorer above .65, Specialist below .35 (0 included), else Balanced reader; nothing below 5 interactions."""
    p = F.round("preference", 9)
    label = F.when(p > 0.65, "Explorer").when(p < 0.35, "Specialist").otherwise("Balanced reader")
    return patterns.withColumn("label", F.when(F.col("total_interactions") >= MIN_SHOWN, label))


def contextual_profile(state: DataFrame, time_of_day_: Column, device: Column) -> DataFrame:
    """What a user is shown of their state: preference, label and weights in the context of now, from 5 interactions on.

    The session length of the context is the number of interactions.
    """
    rows = reader_label(preference(state.withColumnsRenamed({"lambda": "_l", "alpha": "_a", "beta": "_b"})).drop("lambda", "alpha", "beta"))
    rows = rows.withColumnsRenamed({"_l": "lambda", "_a": "alpha", "_b": "beta"})
    rows = rows.withColumns({"time_of_day": time_of_day_, "device": device, "session_length": F.col("total_interactions")})
    shown = F.col("total_interactions") >= MIN_SHOWN
    return contextual(rows).withColumns({c: F.when(shown, F.col(c)) for c in ("preference", "lambda", "alpha", "beta")})


def time_of_day(hour: Column) -> Column:
    return (
        F.when((hour >= 6) & (hour < 12), "morning").when((hour >= 12) & (hour < 18), "afternoon").when((hour >= 18) & (hour < 22), "evening").otherwise("night")
    )


def contextual(rows: DataFrame) -> DataFrame:
    """Weights adjusted for time_of_day, device and session_length, clamped to [0, 1]."""
    one = F.lit(1.0)
    tod, device, long = F.col("time_of_day"), F.col("device"), F.col("session_length") > 10
    lam = F.col("lambda")
    lam = F.when(tod == "morning", lam * 0.8).when(tod == "evening", F.least(one, lam * 1.2)).otherwise(lam)
    lam = F.when(device == "mobile", F.least(one, lam * 1.1)).when(device == "desktop", lam * 0.95).otherwise(lam)
    lam = F.when(long, lam * 0.9).otherwise(lam)
    beta = F.col("beta")
    beta = F.when(tod == "morning", beta * 1.2).when(tod == "evening", beta * 0.8).otherwise(beta)
    beta = F.when(device == "mobile", beta * 0.9).otherwise(beta)
    beta = F.when(long, beta * 1.1).otherwise(beta)
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(one, c))
    return rows.withColumns({"lambda": clamp(lam), "alpha": clamp(F.col("alpha")), "beta": clamp(beta)})


def slider_weights(rows: DataFrame) -> DataFrame:
    """Five sliders to composite weights (4 digits); below .05 the plain baseline is used."""
    main = F.col("main_diversity")
    relevance = F.greatest(F.lit(0.35), 1.0 - main * 0.65)
    budget = 1.0 - relevance
    total = sum((F.col(s) for s in WEIGHTS), F.lit(0.0))
    share = lambda c: F.coalesce(c / F.nullif(total, F.lit(0.0)), F.lit(0.25))
    explore = F.least(F.lit(0.9), main * 0.4 + share(F.col("serendipity")) * 0.5)
    on = main >= 0.05
    cols = {"relevance": relevance, **{s: budget * share(F.col(s)) for s in WEIGHTS}}
    return rows.select(
        "*",
        F.when(on, "composite").otherwise("baseline").alias("method"),
        *[F.when(on, F.round(c, 4)).alias(f"w_{n}") for n, c in cols.items()],
        F.when(on, F.round(explore, 4)).alias("explore_weight"),
    )


def slider_weights_ui(rows: DataFrame) -> DataFrame:
    """The second variant: relevance = 1 - explore level, the level split by the sliders; level 0 means baseline."""
    level = F.col("main_diversity")
    total = sum((F.col(s) for s in WEIGHTS), F.lit(0.0))
    divisor = F.when(total == 0, 1.0).otherwise(total)
    on = level > 0
    cols = {"relevance": 1.0 - level, **{s: level * F.col(s) / divisor for s in WEIGHTS}}
    return rows.select("*", *[F.when(on, c).alias(f"w_{n}") for n, c in cols.items()], F.when(on, level).alias("explore_weight"))


def style_sliders(style: Column) -> dict[str, Column]:
    """Preset sliders of a style; unknown styles are balanced."""

    def pick(i: int) -> Column:
        out = F.lit(STYLES["balanced"][i])
        for name in ("accurate", "explore"):
            out = F.when(style == name, STYLES[name][i]).otherwise(out)
        return out

    return {s: pick(i) for i, s in enumerate(SLIDERS)}


def session_state(clicks: DataFrame) -> DataFrame:
    """Session rows: distinct items read, clicks counted, last access."""
    per_item = clicks.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("_n"), F.max("ts").alias("_t"))
    return per_item.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("history_size"), F.sum("_n").alias("clicked_count"), F.max("_t").alias("last_accessed")
    )


def sessions(events: DataFrame, gap: str = "24 hours") -> DataFrame:
    """Activity sessions that end after more than 24 hours of silence (windows that touch are one)."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("session_start"), F.max("ts").alias("last_event")
    ).drop("w")


def session_history(events: DataFrame, gap: str = "24 hours") -> DataFrame:
    """Items of every user's last session, in order: (user_id, item_id, ord).

    `events`: user_id, ts, event_id, action (seed, click, reset), item_id. Without a reset, items stand in the order of
    their first seed or click. A reset leaves the seed history, in the order of its first seeds; what comes later follows.
    """
    last = sessions(events.select("user_id", "ts"), gap).groupBy("user_id").agg(F.max("session_start").alias("_from"))
    rows = events.join(last, "user_id").where(F.col("ts") >= F.col("_from"))
    at = F.struct("ts", "event_id")
    resets = rows.where(F.col("action") == "reset").groupBy("user_id").agg(F.max(at).alias("_reset"))
    rows = rows.where(F.col("action") != "reset").join(resets, "user_id", "left")
    before = F.coalesce(at < F.col("_reset"), F.lit(False))
    items = rows.groupBy("user_id", "item_id").agg(
        F.min(F.when(before & (F.col("action") == "seed"), at)).alias("_seed"), F.min(F.when(~before, at)).alias("_read")
    )
    kept = items.where(F.col("_seed").isNotNull() | F.col("_read").isNotNull())
    # distinct items of a session: the catalogue bounds a user's rows
    order = W.partitionBy("user_id").orderBy(F.col("_seed").asc_nulls_last(), F.col("_read"))
    return kept.select("user_id", "item_id", (F.row_number().over(order) - 1).cast("bigint").alias("ord"))


def after_reset(events: DataFrame, is_reset: Column) -> DataFrame:
    """Rows of a session after its last reset; without a reset all rows."""
    resets = events.where(is_reset).groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("_reset"))
    joined = events.where(~is_reset).join(resets, "user_id", "left")
    return joined.where(F.col("_reset").isNull() | (F.struct("ts", "event_id") > F.col("_reset"))).drop("_reset")


def newest_first(clicks: DataFrame, n: int = 30) -> DataFrame:
    """Last n items of each user's history, where an item stands once, at its first click."""
    firsts = clicks.groupBy("user_id", "item_id").agg(F.min(F.struct("ts", "event_id")).alias("_first"))
    return top_k(firsts.select("user_id", "item_id", "_first.*"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], n)


def resolve_users(requests: DataFrame, known: DataFrame) -> DataFrame:
    """Login requests against known users (user_id, n_history): unknown ones are new and start empty."""
    rows = requests.join(known, "user_id", "left")
    return rows.select("user_id", F.col("n_history").isNull().alias("is_new_user"), F.coalesce("n_history", F.lit(0)).alias("n_history"))
