"""Personal weights, sessions, sliders and feeds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import rerank as CR
from catalog.diversity import KEY, METHODS_SQL
from catalog.retrieval import RANKED_SQL, SEED_SQL, seeds
from catalog.aggregates import POP_SQL
from catalog.views import Catalog, sql
from lapwing.operators import aggregates as A, diversity as J, personal as U, rerank as H
from lapwing.plans import evaluate as E, recommend as M, tables as T
from lapwing.session import stage, stage_dir
from lapwing.sources import sinks
from lapwing.streaming import state as S

CATALOG = Catalog()
q = CATALOG.add


def feedback(spark, d):
    """Ratings: purchases, value/100 capped at 1, algorithm by item."""
    ev = T.events(spark, d).where(F.col("event_type") == "purchase")
    algorithm = F.when(F.col("item_id") % 3 == 0, "mmr").when(F.col("item_id") % 3 == 1, "calibrated").otherwise("serendipity")
    return ev.select("user_id", "ts", "event_id", algorithm.alias("algorithm"), F.least(F.lit(1.0), F.col("value") / 100).alias("rating"))


def actions(spark, d):
    """click, skip (error) and dwell (view, value seconds) with the item's category."""
    kind = F.when(F.col("event_type") == "click", "click").when(F.col("event_type") == "error", "skip").when(F.col("event_type") == "view", "dwell")
    ev = T.events(spark, d).withColumn("action", kind).where(F.col("action").isNotNull())
    rows = ev.join(T.item_meta(spark, d).select("item_id", "category"), "item_id", "left")
    return rows.select("user_id", "ts", "event_id", "action", F.col("value").alias("dwell_time"), "category")


_FB = """fb AS (SELECT user_id, CASE WHEN item_id % 3 = 0 THEN 'mmr' WHEN item_id % 3 = 1 THEN 'calibrated' ELSE 'serendipity' END AS a, least(1.0, value / 100) AS r,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p FROM ev WHERE event_type = 'purchase'),
    fw AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 0.5::DOUBLE AS l, 0.5::DOUBLE AS al, 0.3::DOUBLE AS b, 0.0::DOUBLE AS c FROM fb
        UNION ALL SELECT fw.user_id, n + 1,
        CASE WHEN a = 'mmr' THEN 0.9 * l + 0.1 * CASE WHEN r > 0.7 THEN l WHEN r < 0.3 THEN 1 - l ELSE 0.3 + 0.4 * ('0x' || substr(md5('42|' || fb.user_id || '|' || p), 1, 8))::BIGINT / 4294967296.0::DOUBLE END ELSE l END,
        CASE WHEN a = 'calibrated' THEN 0.9 * al + 0.1 * CASE WHEN r > 0.7 THEN least(1.0, al + 0.1) WHEN r < 0.3 THEN greatest(0.0, al - 0.1) ELSE al END ELSE al END,
        CASE WHEN a = 'serendipity' THEN 0.9 * b + 0.1 * CASE WHEN r > 0.7 THEN least(1.0, b + 0.1) WHEN r < 0.3 THEN greatest(0.0, b - 0.1) ELSE b END ELSE b END,
        least(1.0, c + 0.05) FROM fw JOIN fb ON fb.user_id = fw.user_id AND fb.p = fw.n),
    fl AS (SELECT user_id, max(n) AS feedback_count, arg_max(l, n) AS "lambda", arg_max(al, n) AS alpha, arg_max(b, n) AS beta, arg_max(c, n) AS confidence FROM fw GROUP BY 1)"""

_PAT = """ac AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'click' WHEN 'error' THEN 'skip' ELSE 'dwell' END AS a, value AS dw, category, ts, event_id,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p FROM ev LEFT JOIN items USING (item_id) WHERE event_type IN ('click', 'error', 'view')),
    pw AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 0.0::DOUBLE AS dwell, 0.0::DOUBLE AS skip, 0::BIGINT AS sw, NULL::VARCHAR AS last, false AS clicked FROM ac
        UNION ALL SELECT pw.user_id, n + 1, CASE WHEN a = 'dwell' THEN (dwell * n + dw) / (n + 1) ELSE dwell END, CASE WHEN a = 'skip' THEN (skip * n + 1) / (n + 1) ELSE skip END,
        sw + CASE WHEN a = 'click' AND clicked AND last IS DISTINCT FROM category THEN 1 ELSE 0 END, CASE WHEN a = 'click' THEN category ELSE last END, clicked OR a = 'click'
        FROM pw JOIN ac ON ac.user_id = pw.user_id AND ac.p = pw.n),
    pl AS (SELECT user_id, max(n) AS total_interactions, arg_max(dwell, n) AS avg_dwell_time, arg_max(skip, n) AS skip_rate, arg_max(sw, n) AS category_switches FROM pw GROUP BY 1),
    pf AS (SELECT *, CASE WHEN total_interactions > 10 THEN 0.4 * least(1.0, avg_dwell_time / 60) + 0.3 * (1 - skip_rate) + 0.3 * least(1.0, category_switches / total_interactions::DOUBLE * 5) ELSE 0.5 END AS preference FROM pl)"""


_PROFILE = """ue AS (SELECT user_id, a, v, label, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p FROM (
        SELECT user_id, ts, event_id, 'rate' AS a, least(1.0, value / 100) AS v, CASE item_id % 3 WHEN 0 THEN 'mmr' WHEN 1 THEN 'calibrated' ELSE 'serendipity' END AS label FROM ev WHERE event_type = 'purchase'
        UNION ALL SELECT user_id, ts, event_id, CASE event_type WHEN 'click' THEN 'click' WHEN 'error' THEN 'skip' ELSE 'dwell' END, value, category FROM ev LEFT JOIN items USING (item_id) WHERE event_type IN ('click', 'error', 'view')) WHERE {where}),
    us AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 0.5::DOUBLE AS l, 0.5::DOUBLE AS al, 0.3::DOUBLE AS b, 0::BIGINT AS fc, 0.0::DOUBLE AS dwell, 0.0::DOUBLE AS skip, 0::BIGINT AS sw, 0::BIGINT AS t, NULL::VARCHAR AS last, false AS clicked FROM ue
        UNION ALL SELECT user_id, n + 1,
        CASE WHEN a <> 'rate' AND t2 > 10 THEN 1 - 0.6 * pref WHEN a = 'rate' AND label = 'mmr' THEN 0.9 * l + 0.1 * CASE WHEN v > 0.7 THEN l WHEN v < 0.3 THEN 1 - l ELSE 0.3 + 0.4 * ('0x' || substr(md5('42|' || user_id || '|' || fc), 1, 8))::BIGINT / 4294967296.0::DOUBLE END ELSE l END,
        CASE WHEN a <> 'rate' AND t2 > 10 THEN 0.3 + 0.4 * pref WHEN a = 'rate' AND label = 'calibrated' THEN 0.9 * al + 0.1 * CASE WHEN v > 0.7 THEN least(1.0, al + 0.1) WHEN v < 0.3 THEN greatest(0.0, al - 0.1) ELSE al END ELSE al END,
        CASE WHEN a <> 'rate' AND t2 > 10 THEN 0.2 + 0.4 * pref WHEN a = 'rate' AND label = 'serendipity' THEN 0.9 * b + 0.1 * CASE WHEN v > 0.7 THEN least(1.0, b + 0.1) WHEN v < 0.3 THEN greatest(0.0, b - 0.1) ELSE b END ELSE b END,
        fc + CASE WHEN a = 'rate' THEN 1 ELSE 0 END, dwell2, skip2, sw2, t2, CASE WHEN a = 'click' THEN label ELSE last END, clicked OR a = 'click'
        FROM (SELECT *, 0.4 * least(1.0, dwell2 / 60) + 0.3 * (1 - skip2) + 0.3 * least(1.0, sw2 / greatest(t2, 1)::DOUBLE * 5) AS pref FROM (
            SELECT us.*, a, v, label, CASE WHEN a = 'dwell' THEN (dwell * t + v) / (t + 1) ELSE dwell END AS dwell2, CASE WHEN a = 'skip' THEN (skip * t + 1) / (t + 1) ELSE skip END AS skip2,
            sw + CASE WHEN a = 'click' AND clicked AND last IS DISTINCT FROM label THEN 1 ELSE 0 END AS sw2, t + CASE WHEN a = 'rate' THEN 0 ELSE 1 END AS t2
            FROM us JOIN ue ON ue.user_id = us.user_id AND ue.p = us.n))),
    ul AS (SELECT user_id, arg_max(l, n) AS "lambda", arg_max(al, n) AS alpha, arg_max(b, n) AS beta, arg_max(fc, n) AS feedback_count, arg_max(dwell, n) AS avg_dwell_time, arg_max(skip, n) AS skip_rate,
        arg_max(sw, n) AS category_switches, arg_max(t, n) AS total_interactions FROM us GROUP BY 1),
    up AS (SELECT *, least(1.0, 0.05 * feedback_count) AS confidence,
        CASE WHEN total_interactions > 10 THEN 0.4 * least(1.0, avg_dwell_time / 60) + 0.3 * (1 - skip_rate) + 0.3 * least(1.0, category_switches / total_interactions::DOUBLE * 5) ELSE 0.5 END AS preference FROM ul)"""
_PROFILE_SQL = """SELECT user_id, round("lambda", 6) AS lambda, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(confidence, 6)::DOUBLE AS confidence, feedback_count,
        round(avg_dwell_time, 6) AS avg_dwell_time, round(skip_rate, 6) AS skip_rate, category_switches, total_interactions FROM up"""
#: What a stream has folded in the end: events that the last watermark, an hour behind the latest, has passed.
_PASSED = "epoch_ms(ts) < (SELECT epoch_ms(max(ts)) - 3600000 FROM {table})"


def profile_events(spark, d):
    return U.rating_events(feedback(spark, d)).unionByName(U.action_events(actions(spark, d)))


@q("user_profile_weights", sql("items ev", _PROFILE_SQL, _PROFILE.format(where="true"), recursive=True))
def user_profile_weights(spark, d):
    """Weights and patterns of every user, moved by ratings and interactions in one order."""
    return A.rounded(U.personal_state(profile_events(spark, d)))


@q(
    "contextual_profile",
    sql(
        "items ev",
        """SELECT user_id, total_interactions, time_of_day, round(CASE WHEN s THEN preference END, 6) AS preference, round(CASE WHEN s THEN greatest(0, least(1, l3)) END, 6)::DOUBLE AS lambda, round(CASE WHEN s THEN alpha END, 6) AS alpha,
        round(CASE WHEN s THEN greatest(0, least(1, b3)) END, 6)::DOUBLE AS beta, CASE WHEN s THEN CASE WHEN round(preference, 9) > 0.65 THEN 'Explorer' WHEN round(preference, 9) < 0.35 THEN 'Specialist' ELSE 'Balanced reader' END END AS label
        FROM (SELECT *, total_interactions >= 5 AS s, CASE WHEN total_interactions > 10 THEN l2 * 0.9 ELSE l2 END AS l3, CASE WHEN total_interactions > 10 THEN b2 * 1.1 ELSE b2 END AS b3 FROM (
        SELECT *, CASE device WHEN 'mobile' THEN least(1, l1 * 1.1) WHEN 'desktop' THEN l1 * 0.95 ELSE l1 END AS l2, CASE device WHEN 'mobile' THEN b1 * 0.9 ELSE b1 END AS b2 FROM (
        SELECT *, CASE time_of_day WHEN 'morning' THEN "lambda" * 0.8 WHEN 'evening' THEN least(1, "lambda" * 1.2) ELSE "lambda" END AS l1, CASE time_of_day WHEN 'morning' THEN beta * 1.2 WHEN 'evening' THEN beta * 0.8 ELSE beta END AS b1
        FROM up JOIN seen USING (user_id))))""",
        _PROFILE.format(where="true")
        + """, seen AS (SELECT user_id, CASE WHEN hour(t) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(t) BETWEEN 12 AND 17 THEN 'afternoon' WHEN hour(t) BETWEEN 18 AND 21 THEN 'evening' ELSE 'night' END AS time_of_day,
        CASE user_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tablet' END AS device FROM (SELECT user_id, max(ts) AS t FROM ev GROUP BY 1))""",
        recursive=True,
    ),
)
def contextual_profile(spark, d):
    """Every user's own weights in the context of their last event, shown from five interactions on."""
    seen = T.events(spark, d).groupBy("user_id").agg(F.max("ts").alias("_t"))
    state = U.personal_state(profile_events(spark, d)).join(seen, "user_id")
    device = F.when(F.col("user_id") % 3 == 0, "mobile").when(F.col("user_id") % 3 == 1, "desktop").otherwise("tablet")
    out = U.contextual_profile(state, U.time_of_day(F.hour("_t")), device)
    return A.rounded(out.select("user_id", "total_interactions", "time_of_day", "preference", "lambda", "alpha", "beta", "label"))


@q(
    "tuner_feedback",
    sql("ev", 'SELECT user_id, round("lambda", 6) AS "lambda", round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(confidence, 6) AS confidence, feedback_count FROM fl', _FB, recursive=True),
)
def tuner_feedback(spark, d):
    """Weights learned from explicit ratings, in order."""
    return A.rounded(U.feedback_weights(feedback(spark, d)))


_P = "user_id, round(avg_dwell_time, 6) AS avg_dwell_time, round(skip_rate, 6) AS skip_rate, category_switches, total_interactions"


@q("tuner_patterns", sql("items ev", f"SELECT {_P} FROM pl", _PAT, recursive=True))
def tuner_patterns(spark, d):
    """Running dwell mean, skip rate and category switches of every user."""
    return A.rounded(U.interaction_patterns(actions(spark, d)))


@q(
    "tuner_preference",
    sql(
        "items ev",
        """SELECT user_id, round(preference, 6) AS preference, round(CASE WHEN total_interactions > 10 THEN 1 - preference * 0.6 END, 6) AS lambda,
        round(CASE WHEN total_interactions > 10 THEN 0.3 + preference * 0.4 END, 6) AS alpha, round(CASE WHEN total_interactions > 10 THEN 0.2 + preference * 0.4 END, 6) AS beta,
        CASE WHEN total_interactions >= 5 THEN CASE WHEN preference > 0.65 THEN 'Explorer' WHEN preference < 0.35 THEN 'Specialist' ELSE 'Balanced reader' END END AS label FROM pf""",
        _PAT,
        recursive=True,
    ),
)
def tuner_preference(spark, d):
    """Diversity preference, implied weights and reader label."""
    rows = U.reader_label(U.preference(U.interaction_patterns(actions(spark, d))))
    return A.rounded(rows.select("user_id", "preference", "lambda", "alpha", "beta", "label"))


@q(
    "user_profiles",
    sql(
        "items ev",
        """SELECT c_custkey AS user_id, round(coalesce("lambda", 0.5), 6) AS lambda, round(coalesce(alpha, 0.5), 6) AS alpha, round(coalesce(beta, 0.3), 6) AS beta, round(coalesce(confidence, 0), 6)::DOUBLE AS confidence,
        coalesce(feedback_count, 0) AS feedback_count, round(coalesce(avg_dwell_time, 0), 6) AS avg_dwell_time, round(coalesce(skip_rate, 0), 6) AS skip_rate, coalesce(category_switches, 0) AS category_switches,
        coalesce(total_interactions, 0) AS total_interactions, round(coalesce(preference, 0.5), 6) AS preference FROM customer LEFT JOIN up ON user_id = c_custkey""",
        _PROFILE.format(where="true"),
        recursive=True,
    ),
)
def user_profiles(spark, d):
    """Whole profile of every customer: weights as ratings and patterns moved them, patterns, feedback count; defaults for users without events."""
    users = T.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    state = U.personal_state(profile_events(spark, d))
    empty = {**U.start(), "feedback_count": 0}
    out = sinks.with_defaults(users, state, empty)
    preference = U.preference(out.drop("lambda", "alpha", "beta")).select("user_id", "preference")
    return A.rounded(out.join(preference, "user_id"))


@q(
    "snapshot_defaults",
    sql(
        "ev",
        """SELECT c_custkey AS user_id, round(coalesce("lambda", 0.5), 6) AS lambda, round(coalesce(alpha, 0.5), 6) AS alpha, round(coalesce(beta, 0.3), 6) AS beta,
        round(coalesce(confidence, 0), 6) AS confidence, coalesce(feedback_count, 0) AS feedback_count FROM customer LEFT JOIN fl ON user_id = c_custkey""",
        _FB,
        recursive=True,
    ),
)
def snapshot_defaults(spark, d):
    """Weights of all customers from the snapshot; unknown users get the defaults."""
    users = T.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return A.rounded(sinks.with_defaults(users, U.feedback_weights(feedback(spark, d)), {**U.DEFAULTS, "feedback_count": 0}))


_CTX = """cx AS (SELECT event_id, CASE WHEN hour(ts) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 17 THEN 'afternoon' WHEN hour(ts) BETWEEN 18 AND 21 THEN 'evening' ELSE 'night' END AS tod,
        CASE event_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tablet' END AS dev, item_id % 20 AS sl FROM ev),
    l1 AS (SELECT *, CASE tod WHEN 'morning' THEN 0.5 * 0.8 WHEN 'evening' THEN least(1, 0.5 * 1.2) ELSE 0.5 END::DOUBLE AS l, CASE tod WHEN 'morning' THEN 0.3 * 1.2 WHEN 'evening' THEN 0.3 * 0.8 ELSE 0.3 END::DOUBLE AS b FROM cx),
    l2 AS (SELECT * REPLACE (CASE dev WHEN 'mobile' THEN least(1, l * 1.1) WHEN 'desktop' THEN l * 0.95 ELSE l END AS l, CASE dev WHEN 'mobile' THEN b * 0.9 ELSE b END AS b) FROM l1),
    l3 AS (SELECT * REPLACE (CASE WHEN sl > 10 THEN l * 0.9 ELSE l END AS l, CASE WHEN sl > 10 THEN b * 1.1 ELSE b END AS b) FROM l2)"""


@q(
    "context_weights",
    sql("ev", "SELECT event_id, tod AS time_of_day, round(l, 6) AS lambda, 0.5::DOUBLE AS alpha, round(b, 6) AS beta FROM l3", _CTX),
)
def context_weights(spark, d):
    """Default weights in the context of every event."""
    device = F.when(F.col("event_id") % 3 == 0, "mobile").when(F.col("event_id") % 3 == 1, "desktop").otherwise("tablet")
    rows = T.events(spark, d).select(
        "event_id",
        U.time_of_day(F.hour("ts")).alias("time_of_day"),
        device.alias("device"),
        (F.col("item_id") % 20).alias("session_length"),
        *[F.lit(U.DEFAULTS[c]).alias(c) for c in ("lambda", "alpha", "beta")],
    )
    return A.rounded(U.contextual(rows).select("event_id", "time_of_day", "lambda", "alpha", "beta"))


@q("time_of_day", sql("ev", "SELECT tod AS time_of_day, count(*) AS n FROM cx GROUP BY 1", _CTX))
def time_of_day(spark, d):
    return T.events(spark, d).groupBy(U.time_of_day(F.hour("ts")).alias("time_of_day")).agg(F.count(F.lit(1)).alias("n"))


@q(
    "session_state",
    sql("clicks", "SELECT user_id, count(DISTINCT item_id) AS history_size, count(*) AS clicked_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_accessed FROM clicks GROUP BY 1"),
)
def session_state(spark, d):
    clicks = T.log(spark, d).where(F.col("label") == 1)
    return U.session_state(clicks).withColumn("last_accessed", F.date_format("last_accessed", "yyyy-MM-dd HH:mm:ss"))


@q(
    "session_history",
    sql("clicks", "SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY min(pos)) - 1 AS ord FROM clicks GROUP BY user_id, item_id"),
)
def session_history(spark, d):
    """Items of each session in the order they were first read."""
    return A.ordered_union(T.clicks(spark, d))


@q(
    "session_ttl",
    sql(
        "ev",
        """SELECT user_id, count(*) AS n_events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_event
        FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 24 HOUR THEN 0 ELSE 1 END AS new FROM ev)) GROUP BY user_id, s""",
    ),
)
def session_ttl(spark, d):
    """Sessions that expire after more than 24 hours of silence."""
    out = U.sessions(T.events(spark, d).select("user_id", "ts"))
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("user_id", "n_events", fmt("session_start"), fmt("last_event"))


@q(
    "session_reset",
    sql(
        "ev",
        """SELECT e.user_id, count(*) AS clicks_since_reset FROM ev e LEFT JOIN (SELECT user_id, arg_max(event_id, (ts, event_id)) AS rid, max(ts) AS rts FROM ev WHERE event_type = 'signup' GROUP BY 1) r USING (user_id)
        WHERE event_type = 'click' AND (rts IS NULL OR (e.ts, e.event_id) > (rts, rid)) GROUP BY 1""",
    ),
)
def session_reset(spark, d):
    """Clicks that count after a session's last reset event."""
    ev = T.events(spark, d).where(F.col("event_type").isin("click", "signup"))
    rows = U.after_reset(ev, F.col("event_type") == "signup")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("clicks_since_reset"))


_SESSION_EVENTS = """se AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 24 HOUR THEN 1 ELSE 0 END AS new
        FROM (SELECT user_id, ts, event_id, item_id, CASE event_type WHEN 'click' THEN 'click' WHEN 'signup' THEN 'reset' ELSE 'seed' END AS a FROM ev WHERE event_type IN ('click', 'signup', 'purchase')) WHERE {where})),
    sf AS (SELECT user_id, max(s) AS s, max(ts) AS last FROM se GROUP BY 1),
    sg AS (SELECT se.* FROM se JOIN sf USING (user_id, s)),
    sr AS (SELECT user_id, max((ts, event_id)) AS r FROM sg WHERE a = 'reset' GROUP BY 1),
    si AS (SELECT sg.user_id, item_id, min(CASE WHEN a = 'seed' AND (ts, event_id) < r THEN (ts, event_id) END) AS seed, min(CASE WHEN r IS NULL OR (ts, event_id) > r THEN (ts, event_id) END) AS read
        FROM sg LEFT JOIN sr USING (user_id) WHERE a <> 'reset' GROUP BY 1, 2),
    sh AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY seed NULLS LAST, read) - 1 AS ord FROM si WHERE seed IS NOT NULL OR read IS NOT NULL)"""


def session_events(ev):
    """Clicks, purchases as seeds and signups as resets."""
    action = F.when(F.col("event_type") == "click", "click").when(F.col("event_type") == "signup", "reset").when(F.col("event_type") == "purchase", "seed")
    return ev.select("user_id", "ts", "event_id", "item_id", action.alias("action")).where(F.col("action").isNotNull())


@q("session_reset_history", sql("ev", "SELECT user_id, item_id, ord FROM sh", _SESSION_EVENTS.format(where="true")))
def session_reset_history(spark, d):
    """Items of every user's last session; a reset brings the seed history back."""
    return U.session_history(session_events(T.events(spark, d)))


@q(
    "recent_history",
    sql(
        "items clicks",
        """SELECT user_id, rank, item_id, category FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank
        FROM (SELECT * FROM clicks QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts, event_id) = 1)) JOIN items USING (item_id) WHERE rank <= 30""",
    ),
)
def recent_history(spark, d):
    """Last 30 items of every user's history with their category."""
    rows = U.newest_first(T.log(spark, d).where(F.col("label") == 1).select("user_id", "ts", "event_id", "item_id"))
    return rows.join(T.item_meta(spark, d), "item_id").select("user_id", "rank", "item_id", "category")


def slider_rows(spark, d):
    e, i = F.col("event_id"), F.col("item_id")
    return T.events(spark, d).select(
        "event_id",
        (i / 97.0).alias("main_diversity"),
        ((e % 7) / 7.0).alias("diversity"),
        ((e % 11) / 11.0).alias("calibration"),
        ((e % 13) / 13.0).alias("serendipity"),
        ((e % 5) / 5.0).alias("fairness"),
    )


_SL = """sl AS (SELECT event_id, item_id / 97.0::DOUBLE AS m, event_id % 7 / 7.0::DOUBLE AS d, event_id % 11 / 11.0::DOUBLE AS c, event_id % 13 / 13.0::DOUBLE AS s, event_id % 5 / 5.0::DOUBLE AS f FROM ev),
    s2 AS (SELECT *, greatest(0.35, 1 - m * 0.65)::DOUBLE AS r, d + c + s + f AS t FROM sl)"""


def _w(x: str) -> str:
    return f"CASE WHEN m >= 0.05 THEN round((1 - r) * CASE WHEN t > 0 THEN {x} / t ELSE 0.25 END, 4) END"


@q(
    "slider_weights",
    sql(
        "ev",
        f"""SELECT event_id, CASE WHEN m >= 0.05 THEN 'composite' ELSE 'baseline' END AS method, CASE WHEN m >= 0.05 THEN round(r, 4) END AS w_relevance, {_w('d')} AS w_diversity, {_w('c')} AS w_calibration,
        {_w('s')} AS w_serendipity, {_w('f')} AS w_fairness, CASE WHEN m >= 0.05 THEN round(least(0.9, m * 0.4 + CASE WHEN t > 0 THEN s / t ELSE 0.25 END * 0.5), 4)::DOUBLE END AS explore_weight FROM s2""",
        _SL,
    ),
)
def slider_weights(spark, d):
    out = U.slider_weights(slider_rows(spark, d))
    return out.select("event_id", "method", *[c for c in out.columns if c.startswith("w_")], "explore_weight")


@q(
    "slider_weights_ui",
    sql(
        "ev",
        """SELECT event_id, CASE WHEN m > 0 THEN round(1 - m, 6) END AS w_relevance, CASE WHEN m > 0 THEN round(m * d / CASE WHEN t = 0 THEN 1 ELSE t END, 6) END AS w_diversity,
        CASE WHEN m > 0 THEN round(m * c / CASE WHEN t = 0 THEN 1 ELSE t END, 6) END AS w_calibration, CASE WHEN m > 0 THEN round(m * s / CASE WHEN t = 0 THEN 1 ELSE t END, 6) END AS w_serendipity,
        CASE WHEN m > 0 THEN round(m * f / CASE WHEN t = 0 THEN 1 ELSE t END, 6) END AS w_fairness, CASE WHEN m > 0 THEN round(m, 6) END AS explore_weight FROM s2""",
        _SL,
    ),
)
def slider_weights_ui(spark, d):
    out = U.slider_weights_ui(slider_rows(spark, d))
    return A.rounded(out.select("event_id", *[c for c in out.columns if c.startswith("w_")], "explore_weight"))


@q(
    "style_presets",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.9 ELSE 0.5 END::DOUBLE AS main_diversity, CASE doc_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.15 ELSE 0.25 END::DOUBLE AS diversity,
    CASE doc_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.05 ELSE 0.25 END::DOUBLE AS calibration, CASE doc_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.55 ELSE 0.25 END::DOUBLE AS serendipity,
    CASE doc_id % 4 WHEN 0 THEN 0.0 ELSE 0.25 END::DOUBLE AS fairness FROM documents""",
)
def style_presets(spark, d):
    """Sliders of the chosen style (one in four rows asks for an unknown style)."""
    code = F.col("doc_id") % 4
    style = F.when(code == 0, "accurate").when(code == 1, "explore").when(code == 2, "balanced").otherwise("other")
    return T.table(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in U.style_sliders(style).items()])


@q(
    "user_directory",
    sql(
        "items hist",
        """SELECT f.user_id, (SELECT count(*) FROM hist h WHERE h.impression_id = f.impression_id) AS history_count, t.category, t.rank FROM f JOIN
        (SELECT h.impression_id, i.category, row_number() OVER (PARTITION BY h.impression_id ORDER BY count(*) DESC, i.category) AS rank FROM hist h JOIN items i USING (item_id) GROUP BY 1, 2 QUALIFY rank <= 3) t USING (impression_id)""",
        "f AS (SELECT user_id, min(impression_id) AS impression_id FROM hist GROUP BY 1)",
    ),
)
def user_directory(spark, d):
    """Users with the length and top categories of their first non-empty history."""
    first = T.history_lengths(spark, d).groupBy("user_id").agg(F.min("impression_id").alias("impression_id"), F.min_by("n_history", "impression_id").alias("history_count"))
    lists = first.select("user_id", "impression_id", F.col("history_count").alias("n_history"), F.lit(None).cast("bigint").alias("bucket"))
    counts = A.category_counts(T.prefixes(spark, d, lists), T.item_meta(spark, d), KEY)
    top = A.top_categories(counts, KEY)
    return first.join(top, "impression_id").select("user_id", "history_count", "category", "rank")


@q(
    "resolve_users",
    sql(
        "hist",
        """SELECT c_custkey AS user_id, n IS NULL AS is_new_user, coalesce(n, 0) AS n_history FROM customer LEFT JOIN
        (SELECT user_id, count(*) AS n FROM hist WHERE bucket = (SELECT max(bucket) FROM log) GROUP BY 1) k ON k.user_id = c_custkey""",
    ),
)
def resolve_users(spark, d):
    """Every customer logs in: known users bring their history, the others start new."""
    requests = T.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    known = T.history(spark, d, T.last_bucket(spark, d)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_history"))
    return U.resolve_users(requests, known)


@q(
    "compare_feed",
    sql(
        "items impr hist",
        """SELECT method, impression_id, round(gini, 6) AS gini, round(coalesce(ild, 0), 6) AS ild, n_categories, round(avg_relevance, 6) AS avg_relevance, round(n_categories / (SELECT count(DISTINCT category) FROM items)::DOUBLE, 6) AS coverage,
        n_categories || '/' || (SELECT count(DISTINCT category) FROM items) AS coverage_str, round(abs(entropy_nats) / ln(2), 6) AS entropy, round(minority_coverage, 6) AS minority_coverage FROM l_g LEFT JOIN l_i USING (method, impression_id)
        JOIN (SELECT method, impression_id, coalesce(count(DISTINCT r.category) / nullif((SELECT count(*) FROM rare), 0)::DOUBLE, 0) AS minority_coverage FROM mrec JOIN items USING (item_id) LEFT JOIN rare r USING (category) GROUP BY 1, 2) USING (method, impression_id)
        JOIN (SELECT method, m.impression_id, avg(p.score) AS avg_relevance FROM mrec m JOIN fe p ON p.impression_id = m.impression_id AND p.item_id = m.item_id GROUP BY 1, 2) USING (method, impression_id)
        WHERE method IN ('baseline', 'composite')""",
        METHODS_SQL + ", rare AS (SELECT category FROM items GROUP BY 1 HAVING count(*) / (SELECT count(*) FROM items)::DOUBLE < 0.05)",
        recursive=True,
    ),
)
def compare_feed(spark, d):
    """Baseline and tuned composite feeds of every test user side by side, with all metrics shown with a feed."""
    recs = feeds(spark, d)
    items = T.items(spark, d)
    rows = J.live_metrics(recs, items, E.BOTH).join(A.category_spread(A.category_counts(recs, items, E.BOTH), E.BOTH).select(*E.BOTH, F.col("unique_categories").alias("n_categories")), E.BOTH)
    relevance = recs.groupBy(*E.BOTH).agg(F.avg("score").alias("avg_relevance"))
    return A.rounded(rows.join(relevance, E.BOTH)).withColumn("entropy", F.abs("entropy"))


def feeds(spark, d):
    cands, ctx = CR.setup(spark, d)
    return stage(E.recommendations(cands, ctx, 10, {m: E.PARAMS[m] for m in ("baseline", "composite")}), "recs")


@q(
    "compare_feed_categories",
    sql("items impr hist", "SELECT method, impression_id, category, n FROM l_c WHERE method IN ('baseline', 'composite')", METHODS_SQL, recursive=True),
)
def compare_feed_categories(spark, d):
    """Category counts of both feeds of every test user."""
    return A.category_counts(feeds(spark, d), T.item_meta(spark, d), E.BOTH)


_SEEDED = RANKED_SQL.replace(POP_SQL, SEED_SQL).replace(
    "th AS (SELECT * FROM hist WHERE bucket = (SELECT max(bucket) FROM log))", "th AS (SELECT user_id AS impression_id, user_id, 0 AS bucket, pos, item_id FROM seed)"
).replace("tl AS (SELECT impression_id FROM heads WHERE bucket = (SELECT max(bucket) FROM log))", "tl AS (SELECT DISTINCT user_id AS impression_id FROM seed)")


@q(
    "cold_start_feed",
    sql(
        "items impr hist",
        "SELECT impression_id AS user_id, item_id, rank, round(score, 6) AS score FROM g_out",
        _SEEDED
        + ",\n"
        + CR.pool_sql(100)
        + ",\n"
        + CR.feature_sql(explore=0.0)
        + ",\n"
        + CR.greedy_sql("fe", CR.COMPOSITE.format(r=0.40, d=0.15, c=0.30, s=0.0, f=0.15)),
        recursive=True,
    ),
)
def cold_start_feed(spark, d):
    """First feed of new users: topic seeds as history, then the composite with the cold-start preset."""
    model, _ = M.prepared(spark, d)
    rows = seeds(spark, d).select(F.col("user_id").alias("impression_id"), "user_id", F.lit(0).cast("bigint").alias("bucket"), "pos", "item_id")
    h = stage(rows, "seeds")
    ctx = H.Context(model.items, model.vectors, model.popularity, h)
    cands = stage(M.recommend(h, h, model, 100), "candidates")
    preset = {"w_relevance": 0.40, "w_diversity": 0.15, "w_calibration": 0.30, "w_serendipity": 0.0, "w_fairness": 0.15, "explore_weight": 0.0}
    return A.rounded(H.rerank("composite", cands, ctx, 10, **preset)).withColumnRenamed("impression_id", "user_id")


# --------------------------------------------------------------------------- streaming twins


def _arriving(spark, d, build, mode: str = "update", steps: int = 5) -> str:
    """Rows of the stream `build(events)` while the events arrive in steps, each up to 50 minutes late, in shuffled files.

    The table is dealt to the steps by arrival; every step runs all it finds, from the state of the step before.
    """
    folder = f"{stage_dir(spark)}/lapwing/stream-{uuid.uuid4().hex}"
    late = F.make_interval(mins=F.pmod(F.xxhash64("event_id"), F.lit(50)).cast("int"))
    ev = T.events(spark, d).withColumn("_arrival", F.unix_micros(F.col("ts") + late))
    cuts = ev.agg(F.percentile_approx("_arrival", [i / steps for i in range(1, steps)], 10_000)).first()[0] or []
    step = sum((F.col("_arrival") > c).cast("int") for c in cuts) if cuts else F.lit(0)
    dealt = stage(ev.withColumn("_step", step).drop("_arrival").repartition(F.xxhash64("event_id")), "events")
    rows = dealt.drop("_step")
    S.use_rocksdb(spark)
    for i in range(steps):
        # a batch without data, to ring the timers of the last watermark, is due after the last step only
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(i == steps - 1).lower())
        dealt.where(F.col("_step") == i).drop("_step").write.mode("append").parquet(f"{folder}/events")
        arrived = spark.readStream.schema(rows.schema).parquet(f"{folder}/events")
        S.run_to_table(build(arrived), f"{folder}/rows", f"{folder}/checkpoint", mode)
    return f"{folder}/rows"


def _profile_stream(spark, d, kinds):
    """Profiles from the events of these types, whose latest one sets the watermark."""
    meta = T.item_meta(spark, d).select("item_id", "category")
    action = F.when(F.col("event_type") == "purchase", "rate").when(F.col("event_type") == "click", "click").when(F.col("event_type") == "error", "skip").otherwise("dwell")
    algorithm = F.when(F.col("item_id") % 3 == 0, "mmr").when(F.col("item_id") % 3 == 1, "calibrated").otherwise("serendipity")
    rate = F.col("action") == "rate"

    def build(ev):
        rows = ev.where(F.col("event_type").isin(*kinds)).withColumn("action", action).join(meta, "item_id", "left")
        value = F.when(rate, F.least(F.lit(1.0), F.col("value") / 100)).otherwise(F.col("value"))
        return S.profile_stream(rows.select("user_id", "ts", "event_id", "action", value.alias("value"), F.when(rate, algorithm).otherwise(F.col("category")).alias("label")))

    return S.latest(spark, _arriving(spark, d, build))


_ACTED = "(SELECT * FROM ev WHERE event_type IN ('click', 'error', 'view'))"
_RATED = "(SELECT * FROM ev WHERE event_type = 'purchase')"
_BOTH = "(SELECT * FROM ev WHERE event_type IN ('click', 'error', 'view', 'purchase'))"


@q("stream_patterns", sql("items ev", f"SELECT {_P} FROM pl", _PAT.replace("WHERE event_type IN ('click', 'error', 'view')", "WHERE event_type IN ('click', 'error', 'view') AND " + _PASSED.format(table=_ACTED)), recursive=True))
def stream_patterns(spark, d):
    """Interaction patterns kept as streaming state: what the watermark has passed, as the batch form has it."""
    out = _profile_stream(spark, d, ("click", "error", "view"))
    return A.rounded(out.select("user_id", "avg_dwell_time", "skip_rate", "category_switches", "total_interactions"))


@q(
    "stream_feedback",
    sql(
        "ev",
        'SELECT user_id, round("lambda", 6) AS "lambda", round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(confidence, 6) AS confidence, feedback_count FROM fl',
        _FB.replace("WHERE event_type = 'purchase'", "WHERE event_type = 'purchase' AND " + _PASSED.format(table=_RATED)),
        recursive=True,
    ),
)
def stream_feedback(spark, d):
    """Feedback weights kept as streaming state: what the watermark has passed, as the batch form has it."""
    out = _profile_stream(spark, d, ("purchase",))
    return A.rounded(out.select("user_id", "lambda", "alpha", "beta", "confidence", "feedback_count"))


@q("stream_profiles", sql("items ev", _PROFILE_SQL, _PROFILE.format(where=_PASSED.format(table=_BOTH)), recursive=True))
def stream_profiles(spark, d):
    """Ratings and interactions move one streaming state per user, in event order whatever the order of arrival."""
    return A.rounded(_profile_stream(spark, d, ("click", "error", "view", "purchase")))


def _session_stream(spark, d, with_history=False):
    return S.latest(spark, _arriving(spark, d, lambda ev: S.session_stream(session_events(ev), with_history=with_history)))


_SESSIONS = "(SELECT * FROM ev WHERE event_type IN ('click', 'signup', 'purchase'))"
_SESSIONS_PASSED = _SESSION_EVENTS.format(where=_PASSED.format(table=_SESSIONS))


@q(
    "stream_sessions",
    sql(
        "ev",
        f"""SELECT f.user_id, (SELECT count(*) FROM sh WHERE sh.user_id = f.user_id) AS history_size, (SELECT count(*) FROM sg LEFT JOIN sr USING (user_id) WHERE sg.user_id = f.user_id AND a = 'click' AND (r IS NULL OR (ts, event_id) > r)) AS clicked_count,
        strftime(f.last, '%Y-%m-%d %H:%M:%S') AS last_accessed, epoch_ms(f.last) + 86400000 < (SELECT epoch_ms(max(ts)) - 3600000 FROM {_SESSIONS}) AS expired FROM sf f""",
        _SESSIONS_PASSED,
    ),
)
def stream_sessions(spark, d):
    """Session state with seeds, resets and 24 h expiry against the watermark."""
    return _session_stream(spark, d).withColumn("last_accessed", F.date_format("last_accessed", "yyyy-MM-dd HH:mm:ss"))


@q("stream_session_history", sql("ev", "SELECT user_id, item_id, ord FROM sh", _SESSIONS_PASSED))
def stream_session_history(spark, d):
    """Items of each user's last session as the stream keeps them; equals the batch form on what the watermark has passed."""
    out = _session_stream(spark, d, with_history=True)
    return out.select("user_id", F.posexplode("history").alias("ord", "item_id")).withColumn("ord", F.col("ord").cast("bigint"))


@q(
    "stream_session_windows",
    sql(
        "ev",
        """SELECT user_id, count(*) AS n_events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_event
        FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 24 HOUR THEN 0 ELSE 1 END AS new FROM ev))
        GROUP BY user_id, s HAVING max(ts) + INTERVAL 24 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM ev)""",
    ),
)
def stream_session_windows(spark, d):
    """Closed 24 h sessions in append mode; the last open sessions stay behind the watermark."""
    out = spark.read.parquet(_arriving(spark, d, lambda ev: S.session_window_stream(ev.select("user_id", "ts")), "append"))
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("user_id", "n_events", fmt("session_start"), fmt("last_event"))
