"""Concentration, diversity and echo-chamber metrics of recommendation lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lapwing.functions import vectors as V
from lapwing.functions.ranking import exact_quantiles

SMOOTHING = 0.01
SYSTEM_SMOOTHING = 1e-9


def gini(counts: DataFrame, keys: list[str], singleton: float = 1.0, value: str = "n") -> DataFrame:
    """Gini of the present categories per key. A single category gives `singleton`."""
    order = W.partitionBy(*keys).orderBy(F.col(value))
    ranked = counts.withColumn("_i", F.row_number().over(order))
    size, total = F.count(F.lit(1)), F.sum(value)
    formula = 2 * F.sum(F.col("_i") * F.col(value)) / (size * total) - (size + 1) / size
    return ranked.groupBy(*keys).agg(F.when(size == 1, F.lit(float(singleton))).otherwise(formula).alias("gini"))


def share_metrics(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Entropy (nats and bits), category ILD, category count and list size per key, from category counts."""
    per_key = counts.groupBy(*keys).agg(
        F.sum("n").alias("size"),
        F.count(F.lit(1)).alias("n_categories"),
        F.sum(F.col("n") * F.ln("n")).alias("_nlogn"),
        F.sum(F.col("n") * (F.col("n") - 1)).alias("_same"),
    )
    nats = F.ln("size") - F.col("_nlogn") / F.col("size")
    pairs = F.col("size") * (F.col("size") - 1)
    return per_key.select(
        *keys,
        "size",
        "n_categories",
        nats.alias("entropy_nats"),
        (nats / F.ln(F.lit(2.0))).alias("entropy_bits"),
        F.when(pairs > 0, 1 - F.col("_same") / pairs).otherwise(F.lit(0.0)).alias("category_ild"),
    )


def coverage(metrics: DataFrame, n_categories: Column) -> DataFrame:
    """Share of all categories present, also as text `x/y`."""
    total = n_categories.cast("bigint")
    return metrics.withColumn("coverage", F.col("n_categories") / total).withColumn(
        "coverage_str", F.concat(F.col("n_categories").cast("string"), F.lit("/"), total.cast("string"))
    )


def n_categories(items: DataFrame, category: str = "category") -> Column:
    return items.agg(F.countDistinct(category)).scalar()


def ild(lists: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Mean pairwise 1 - dot per list, 0 below two known items; a list without any known vector keeps its row.

    Uses sum over pairs of e_i.e_j = (|sum e|^2 - sum |e|^2) / 2, so no pair is ever materialised and the
    sums merge map-side.
    """
    rows = lists.join(vectors.select("item_id", "embedding"), "item_id")
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        V.sum_vector(F.col("embedding")).alias("_s"),
        F.sum(V.dot(F.col("embedding"), F.col("embedding"))).alias("_q"),
    )
    return ild_of_sums(sums, lists.select(*keys).distinct(), keys)


def ild_of_sums(sums: DataFrame, lists: DataFrame, keys: list[str]) -> DataFrame:
    """`ild` of the distinct `lists` from the number, vector sum and squared norms of their known items (_n, _s, _q)."""
    pairs = F.col("_n") * (F.col("_n") - 1)
    dots = V.dot(F.col("_s"), F.col("_s")) - F.col("_q")
    known = sums.select(*keys, F.when(pairs > 0, 1 - dots / pairs).otherwise(F.lit(0.0)).alias("_ild"))
    return lists.select(*keys).join(known, keys, "left").select(*keys, F.coalesce("_ild", F.lit(0.0)).alias("ild"))


def calibration_error(rec_counts: DataFrame, hist_counts: DataFrame, keys: list[str], total_categories: Column, smoothing: float = SMOOTHING) -> DataFrame:
    """KL(history || recommendations) over all categories, smoothed.

    Only categories present in either list need a row; all absent ones share one term, added in closed form,
    so no list x category grid is built.
    """
    r = rec_counts.select(*keys, "category", F.col("n").alias("_r"), F.lit(0).cast("bigint").alias("_h"))
    h = hist_counts.select(*keys, "category", F.lit(0).cast("bigint").alias("_r"), F.col("n").alias("_h"))
    both = r.unionByName(h).groupBy(*keys, "category").agg(F.sum("_r").alias("_r"), F.sum("_h").alias("_h"))
    sums = both.groupBy(*keys).agg(
        F.sum("_r").alias("_rt"),
        F.sum("_h").alias("_ht"),
        F.count(F.lit(1)).alias("_present"),
        F.sum((F.col("_h") + smoothing) * F.ln((F.col("_h") + smoothing) / (F.col("_r") + smoothing))).alias("_raw"),
    ).where((F.col("_rt") > 0) & (F.col("_ht") > 0))
    c = total_categories.cast("double")
    p_total, q_total = F.col("_ht") + smoothing * c, F.col("_rt") + smoothing * c
    # sum p ln(p/q) with p = (h+s)/P, q = (r+s)/Q: the absent categories add nothing to _raw since ln(s/s) = 0,
    # and the masses p sum to 1, which leaves ln(Q/P)
    return sums.select(*keys, (F.col("_raw") / p_total + F.ln(q_total / p_total)).alias("calibration_error"))


def user_metrics(lists: DataFrame, history: DataFrame, items: DataFrame, keys: list[str], lengths: DataFrame) -> DataFrame:
    """One row per list: gini, ild, coverage, calibration_error, entropy, category count, history length and gini."""
    from lapwing.operators.aggregates import category_counts

    rec = category_counts(lists, items, keys)
    hist = category_counts(history, items, keys)
    total = n_categories(items)
    shares = coverage(share_metrics(rec, keys), total)
    parts = [
        gini(rec, keys),
        ild(lists, items, keys),
        calibration_error(rec, hist, keys, total),
        gini(hist, keys).withColumnRenamed("gini", "history_gini"),
        lengths.select(*keys, F.col("n_history").alias("history_length")),
    ]
    out = shares.select(*keys, "coverage", "entropy_nats", "entropy_bits", "n_categories")
    for part in parts:
        out = out.join(part, keys)
    return out


def overall(metrics: DataFrame) -> DataFrame:
    """Means and medians over all lists. `metrics` is read several times."""
    median = lambda c: F.lit(exact_quantiles(metrics, c, [0.5])[0]).cast("double")
    return metrics.agg(
        F.count(F.lit(1)).alias("n_users"),
        F.avg("gini").alias("avg_gini"),
        median("gini").alias("median_gini"),
        F.avg("ild").alias("avg_ild"),
        median("ild").alias("median_ild"),
        F.avg("coverage").alias("avg_coverage"),
        F.avg("calibration_error").alias("avg_calibration_error"),
        F.avg("entropy_nats").alias("avg_entropy_nats"),
        F.avg("n_categories").alias("avg_unique_categories"),
    )


def segment(g: Column) -> Column:
    """filter_bubble > .8, balanced [.4, .6], diverse < .4; the gap between .6 and .8 is `other`."""
    return (
        F.when(g > 0.8, "filter_bubble").when((g >= 0.4) & (g <= 0.6), "balanced").when(g < 0.4, "diverse").otherwise("other")
    )


def segments(metrics: DataFrame) -> DataFrame:
    """Count, share and means per segment; empty segments keep a zero row."""
    total = metrics.agg(F.count(F.lit(1))).scalar()
    found = metrics.groupBy(segment(F.round("gini", 9)).alias("segment")).agg(
        F.count(F.lit(1)).alias("n_users"),
        F.avg("gini").alias("avg_gini"),
        F.avg("ild").alias("avg_ild"),
        F.avg("calibration_error").alias("avg_calibration_error"),
    )
    names = metrics.sparkSession.createDataFrame([("filter_bubble",), ("balanced",), ("diverse",), ("other",)], "segment STRING")
    out = names.join(found, "segment", "left").fillna(0)
    return out.withColumn("pct", F.col("n_users") * 100.0 / total)


def percentiles(metrics: DataFrame, columns: tuple[str, ...] = ("gini", "ild"), shares=(0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """(metric, share, value) with linear interpolation. `metrics` is read several times."""
    rows = [(c, float(p), v) for c in columns for p, v in zip(shares, exact_quantiles(metrics, c, list(shares)))]
    return metrics.sparkSession.createDataFrame(rows, "metric string, share double, value double")


def hhi(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sum of squared shares."""
    return counts.groupBy(*(keys or [])).agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("system_hhi"))


def system_kl(corpus: DataFrame, rec_counts: DataFrame, keys: list[str] | None = None, smoothing: float = SYSTEM_SMOOTHING) -> DataFrame:
    """KL(corpus || recommendations) over the corpus categories; both sides are (category, n), the second per key.

    Categories without a recommendation share one smoothed probability, so their part is the corpus total minus
    the part of the present ones and no key x category grid is built.
    """
    keys = keys or []
    total, size = corpus.agg(F.sum("n")).scalar(), corpus.agg(F.count(F.lit(1))).scalar()
    p = corpus.select("category", (F.col("n") / total).alias("_p"))
    entropy = p.agg(F.sum(F.col("_p") * F.ln("_p"))).scalar()
    rec_total = rec_counts.groupBy(*keys).agg(F.sum("n").alias("_t")) if keys else rec_counts.agg(F.sum("n").alias("_t"))
    rows = rec_counts.join(p, "category")
    parts = rows.groupBy(*keys).agg(
        F.sum(F.col("_p") * F.ln(F.col("n") + smoothing)).alias("_present"), F.sum("_p").alias("_mass")
    )
    parts = parts.join(rec_total, keys) if keys else parts.withColumn("_t", rec_total.scalar())
    log_q = F.col("_present") + (1 - F.col("_mass")) * F.ln(F.lit(smoothing)) - F.ln(F.col("_t") + smoothing * size)
    return parts.select(*keys, (entropy - log_q).alias("system_kl"))


def population_gini(lists: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Gini of all recommendations together, categories recommended and mean categories and Gini per list."""
    from lapwing.operators.aggregates import category_counts

    return population_of(category_counts(lists, items, keys), keys)


def population_of(per_list: DataFrame, keys: list[str]) -> DataFrame:
    """`population_gini` from category counts per list."""
    everything = per_list.groupBy("category").agg(F.sum("n").alias("n"))
    per = gini(per_list, keys, singleton=0.0).agg(F.avg("gini").alias("avg_gini"))
    spread = per_list.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg(F.avg("c").alias("avg_coverage"))
    one = everything.agg(F.count(F.lit(1)).alias("unique_categories"))
    return (
        one.withColumn("overall_gini", gini(everything, [], singleton=0.0).select("gini").scalar())
        .withColumn("avg_gini", per.scalar())
        .withColumn("avg_coverage", spread.scalar())
    )


def minority_coverage(lists: DataFrame, items: DataFrame, keys: list[str], column: str = "category", limit: float = 0.05) -> DataFrame:
    """Share of the rare values (below `limit` of the corpus) that a list shows; 0 without rare values."""
    total = items.agg(F.count(F.lit(1))).scalar()
    rare = items.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") / total < limit).select(column)
    n_rare = rare.agg(F.count(F.lit(1))).scalar()
    shown = lists.join(items.select("item_id", column), "item_id").select(*keys, column).distinct()
    hits = shown.join(rare.withColumn("_rare", F.lit(1)), column, "left").groupBy(*keys).agg(F.count("_rare").alias("_h"))
    return hits.select(*keys, F.coalesce(F.col("_h") / F.nullif(n_rare, F.lit(0)), F.lit(0.0)).alias("minority_coverage"))


def live_metrics(lists: DataFrame, items: DataFrame, keys: list[str], minority: str = "category", limit: float = 0.05, vectors: bool = True) -> DataFrame:
    """Metrics shown with a feed: gini, ild (vectors or categories), coverage, entropy and minority coverage."""
    from lapwing.operators.aggregates import category_counts

    counts = category_counts(lists, items, keys)
    base = coverage(share_metrics(counts, keys), n_categories(items))
    out = base.select(*keys, "coverage", "coverage_str", F.col("entropy_bits").alias("entropy"), F.col("category_ild"))
    out = out.join(gini(counts, keys), keys).join(minority_coverage(lists, items, keys, minority, limit), keys)
    if vectors:
        return out.drop("category_ild").join(ild(lists, items, keys), keys)
    return out.withColumnRenamed("category_ild", "ild")


# fixed values: limits of the good/bad flags
FLAGS = {"gini": ("<", 0.5), "ild": (">", 0.4), "coverage": (">", 0.25), "entropy": (">", 1.5), "minority_coverage": (">=", 0.4)}


def flags(metrics: DataFrame) -> DataFrame:
    tests = {"<": lambda c, x: c < x, ">": lambda c, x: c > x, ">=": lambda c, x: c >= x}
    return metrics.select("*", *[tests[op](F.round(c, 9), x).alias(f"{c}_ok") for c, (op, x) in FLAGS.items()])


# fixed values: direction of each metric, and the pass limits of a re-ranker
BETTER = {"avg_gini": "min", "avg_coverage": "max", "avg_ild": "max", "system_hhi": "min", "system_kl": "min"}
LIMITS = {"avg_gini": ("<", 0.6), "avg_coverage": (">", 0.25), "avg_ild": (">", 0.45), "auc": (">=", 0.55)}


def best_methods(results: DataFrame, base: str = "baseline") -> DataFrame:
    """Best re-ranker per metric, its value, the base value, the reduction in percent of the base and the gain in points."""
    others = results.where(F.col("method") != base)
    base_row = results.where(F.col("method") == base)
    picks = []
    for metric, direction in BETTER.items():
        sign = -1 if direction == "min" else 1
        best = others.select(F.struct((-sign * F.round(metric, 9)).alias("o"), "method", F.col(metric).alias("value")).alias("s"))
        row = best.agg(F.min("s").alias("s"))
        picks.append(row.select(F.lit(metric).alias("metric"), F.col("s.method").alias("method"), F.col("s.value").alias("value"), base_row.select(metric).scalar().alias("base")))
    out = picks[0]
    for p in picks[1:]:
        out = out.unionByName(p)
    change = (F.col("base") - F.col("value")) / F.greatest(F.abs("base"), F.lit(1e-9)) * 100
    return out.withColumn("reduction_pct", change).withColumn("gain", F.col("value") - F.col("base"))


def trade_off(results: DataFrame, base: str = "baseline") -> DataFrame:
    """Gini reduction of the most balanced re-ranker per percent of NDCG lost."""
    one = results.where(F.col("method") != base).agg(
        F.min(F.struct(F.round("avg_gini", 9).alias("o"), "method", "avg_gini", "ndcg")).alias("s")
    )
    ref = results.where(F.col("method") == base)
    drop = lambda c: (ref.select(c).scalar() - F.col(f"s.{c}")) / F.greatest(F.abs(ref.select(c).scalar()), F.lit(1e-9)) * 100
    rows = one.select(F.col("s.method").alias("method"), drop("avg_gini").alias("gini_reduction_pct"), drop("ndcg").alias("ndcg_cost_pct"))
    return rows.withColumn("trade_off_ratio", F.col("gini_reduction_pct") / F.greatest(F.abs("ndcg_cost_pct"), F.lit(0.01)))


def threshold_counts(results: DataFrame, base: str = "baseline") -> DataFrame:
    """Re-rankers that pass each limit."""
    tests = {"<": lambda c, x: c < x, ">": lambda c, x: c > x, ">=": lambda c, x: c >= x}
    one = results.where(F.col("method") != base).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(tests[op](F.round(m, 9), x)).alias(m) for m, (op, x) in LIMITS.items()]
    )
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("n_pass"), F.col("_n").alias("n_methods")) for m in LIMITS]
    return one.select(F.inline(F.array(*cells)))


def long_form(results: DataFrame, key: str = "method") -> DataFrame:
    """(method, metric, value) rows of a wide result table."""
    cells = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in results.columns if c != key]
    return results.select(key, F.inline(F.array(*cells)))


def deltas(old: DataFrame, new: DataFrame) -> DataFrame:
    """Metric by metric difference of two (metric, value) tables."""
    o, n = old.select("metric", F.col("value").alias("old")), new.select("metric", F.col("value").alias("new"))
    return o.join(n, "metric").withColumn("delta", F.col("new") - F.col("old"))
