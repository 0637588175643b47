"""Mixing sources to target weights by hierarchical budgeting; DataFrame functions only.

Leaves are (domain, language, source). The token budget goes down the tree: at each node, children share it by weight, and
what a child cannot fill goes to its siblings by their weights; only what all of them together lack was never given to the
node. A leaf takes its rows in the order of a seeded hash, epoch after epoch, up to its tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lapwing.llm.columns import as_before, by_place
from lapwing.session import stage

LEVELS = ["domain", "lang", "source"]
ALIKE = ["doc_id", "lang", "source", "tokens"]
SEED = 7
BUDGET_SHARE = 0.5
EPOCHS = 3
PIECE_ROWS = 5_000
WHOLE = "decimal(38,0)"
#: Weights by level and name, whole numbers; all other nodes weigh 1.
WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2}, "lang": {"en": 5, "de": 2, "fr": 2}, "source": {"src0": 2}}


def tokens(text: str = "text") -> Column:
    """White-space words of a text; null has none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("bigint")


def domain_of(source: str = "source") -> Column:
    """`documents` has no domain: sources are dealt to four domains by the first digit of their digest."""
    digit = F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 1))
    return F.concat(F.lit("domain"), ((digit - 1) % 4).cast("string"))


def weighed(nodes: DataFrame, level: str, weights: dict) -> DataFrame:
    own = weights.get(level, {})
    weight = F.lit(1)
    for name, value in own.items():
        weight = F.when(F.col(level) == name, value).otherwise(weight)
    return nodes.withColumn("weight", weight.cast(WHOLE))


def share_out(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Add `budget` to children that have capacity, weight and their parent's `given`: water-filling in whole tokens.

    Children in order of capacity / weight fill up as long as their share exceeds their capacity; the rest share what is
    left by weight, rounded down.
    """
    order = W.partitionBy(*parents).orderBy(F.col("capacity").cast("double") / F.col("weight").cast("double"), F.col(name).asc_nulls_first())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*parents)
    rows = children.withColumns({
        "_cap": F.coalesce(F.sum("capacity").over(before), F.lit(0)).cast(WHOLE),
        "_weight": F.coalesce(F.sum("weight").over(before), F.lit(0)).cast(WHOLE),
        "_all": F.sum("weight").over(whole).cast(WHOLE),
    })
    rows = rows.withColumn("_left", F.col("given") - F.col("_cap")).withColumn("_rest", F.col("_all") - F.col("_weight"))
    rows = rows.withColumn("_full", (F.col("_left") > 0) & (F.col("capacity") * F.col("_rest") <= F.col("_left") * F.col("weight")))
    # the first child that does not fill up sees what is left for it and all later ones
    first = F.min(F.when(~F.col("_full"), F.struct("_cap", "_weight"))).over(whole)
    rows = rows.withColumn("_first", first)
    part = F.expr("((given - _first._cap) * weight) div (_all - _first._weight)")
    budget = F.when(F.col("_full"), F.col("capacity")).otherwise(F.greatest(F.lit(0), F.least(F.col("capacity"), part)))
    return rows.withColumn("budget", budget.cast("bigint")).drop("_cap", "_weight", "_all", "_left", "_rest", "_full", "_first")


def leaf_budgets(leaves: DataFrame, budget_share: float, epochs: int, weights: dict) -> DataFrame:
    """Budget of each leaf (domain, lang, source, available, docs). The tree is as large as the number of sources.

    Capacity is `epochs` times what a leaf has; the total budget is a share of all tokens.
    """
    capacity = (F.col("available") * epochs).cast(WHOLE)
    level = [leaves.withColumn("capacity", capacity)]
    for depth in (2, 1):
        level.insert(0, level[0].groupBy(*LEVELS[:depth]).agg(F.sum("capacity").cast(WHOLE).alias("capacity")))
    total = leaves.agg(F.floor(F.coalesce(F.sum("available"), F.lit(0)).cast("double") * budget_share).cast("bigint")).first()[0]
    given = None
    for depth, (nodes, name) in enumerate(zip(level, LEVELS)):
        nodes = weighed(nodes, name, weights)
        if depth == 0:
            rows = nodes.withColumn("given", F.lit(total).cast(WHOLE))
            parents = [F.lit(0)]
        else:
            same = [nodes[c].eqNullSafe(given[c]) for c in LEVELS[:depth]]
            rows = nodes.join(given, same).drop(*[given[c] for c in LEVELS[:depth]])
            parents = LEVELS[:depth]
        rows = share_out(rows, parents, name)
        given = rows.select(*LEVELS[: depth + 1], F.col("budget").cast(WHOLE).alias("given"))
    return rows.drop("capacity", "weight", "given")


def dealt(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """Rows with their leaf's budget. Leaves join null-safe on all three names."""
    own = leaves.select(*[F.col(c).alias(f"_{c}") for c in LEVELS], "available", "docs", "budget")
    same = [rows[c].eqNullSafe(own[f"_{c}"]) for c in LEVELS]
    return rows.join(own, same).drop(*[f"_{c}" for c in LEVELS])


def order_key(seed: int, epoch: Column, key: str) -> Column:
    """Place of a row in an epoch: 60 bits of a seeded digest."""
    text = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def select(slim: DataFrame, key: str = "doc_id", budget_share: float = BUDGET_SHARE, epochs: int = EPOCHS, weights: dict | None = None, seed: int = SEED) -> DataFrame:
    """Rows (key, domain, lang, source, tokens) with `times`: how many epochs of its leaf take the row; 0 for none.

    Whole epochs take every row; in the last one, rows come in seeded order while the tokens before them stay below what
    is left, so a leaf goes over its budget by less than one row. Rows without tokens are taken in whole epochs and while
    tokens are left. Null names are nodes of their own, ties in the order follow the key, then the tokens; repeated rows
    count each; an empty table stays empty. A leaf with a third of all rows is cut into pieces by the order key: prefix sums run over
    pieces, then inside them.
    """
    weights = WEIGHTS if weights is None else weights
    rows = stage(slim.select(key, *LEVELS, "tokens"), "mixing")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("docs"))
    leaves = stage(leaf_budgets(leaves, budget_share, epochs, weights), "leaves")
    rows = dealt(rows, leaves)
    full = F.when(F.col("available") > 0, F.least(F.lit(epochs), F.expr("budget div available"))).otherwise(0)
    rows = rows.withColumn("full", full.cast("bigint")).withColumn("rest", F.col("budget") - F.col("full") * F.col("available"))
    rows = rows.withColumn("_order", order_key(seed, F.col("full"), key))
    pieces = F.greatest(F.lit(1), F.expr(f"docs div {PIECE_ROWS}"))
    # the top 30 bits of the order times the pieces: grows with the order
    rows = rows.withColumn("_piece", F.expr("shiftright(_order, 30)") * pieces).withColumn("_piece", F.expr("shiftright(_piece, 30)"))
    sizes = rows.groupBy(*LEVELS, "_piece").agg(F.sum("tokens").alias("_size"))
    ahead = W.partitionBy(*LEVELS).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_ahead", F.coalesce(F.sum("_size").over(ahead), F.lit(0))).drop("_size")
    sizes = sizes.select(*[F.col(c).alias(f"_{c}") for c in LEVELS], F.col("_piece").alias("_of"), "_ahead")
    same = [rows[c].eqNullSafe(sizes[f"_{c}"]) for c in LEVELS] + [rows["_piece"] == sizes["_of"]]
    rows = rows.join(sizes, same).drop(*[f"_{c}" for c in LEVELS], "_of")
    inside = W.partitionBy(*LEVELS, "_piece").orderBy("_order", key, "tokens").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("_ahead") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    taken = (start < F.col("rest")).cast("bigint")
    return rows.withColumn("times", F.col("full") + taken).select(key, *LEVELS, "tokens", "budget", "times")


def slim_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", domain_of().alias("domain"), "lang", "source", tokens().alias("tokens"))


def digest(docs: DataFrame) -> DataFrame:
    """Every document with its leaf, tokens, the leaf's budget and how often the mixture takes it."""
    return select(slim_of(docs)).withColumn("taken_tokens", F.col("tokens") * F.col("times"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that the mixture takes, each as often as epochs take it; same columns, whatever their names.

    Rows that agree in id, language, source and tokens are told apart only where a leaf's budget ends among them, which
    is at most one such group per leaf: there, rows are counted, by task, and the first ones get the further epoch.
    """
    options.setdefault("epochs", 1)
    plan = select(slim_of(docs), **options).groupBy(*ALIKE).agg(F.min("times").alias("low"), F.max("times").alias("high"), F.sum("times").alias("all"), F.count(F.lit(1)).alias("n"))
    plan = stage(plan.where("high > 0").select(*[F.col(c).alias(f"_{c}") for c in ALIKE], "low", "high", (F.col("all") - F.col("low") * F.col("n")).alias("more")), "plan")
    rows, (key, text, lang, source) = by_place(docs, "doc_id", "text", "lang", "source")
    own = {"doc_id": F.col(key), "lang": F.col(lang), "source": F.col(source), "tokens": tokens(text)}
    same = [own[c].eqNullSafe(F.col(f"_{c}")) for c in ALIKE]
    rows = rows.join(plan, same)
    whole = rows.where("low = high").withColumn("times", F.col("low"))
    cut = plan.where("low < high")
    if not cut.isEmpty():
        split = stage(rows.where("low < high").withColumn("_row", F.monotonically_increasing_id()), "split")
        group = [f"_{c}" for c in ALIKE]
        # rows before a task's first one, of the same group; then rows inside the task
        split = split.withColumn("_task", F.expr("shiftright(_row, 33)"))
        sizes = split.groupBy(*group, "_task").agg(F.count(F.lit(1)).alias("_size"))
        ahead = F.sum("_size").over(W.partitionBy(*group).orderBy("_task").rowsBetween(W.unboundedPreceding, -1))
        sizes = sizes.select(*[F.col(c).alias(f"{c}_of") for c in group], F.col("_task").alias("_task_of"), F.coalesce(ahead, F.lit(0)).alias("_ahead"))
        split = split.join(sizes, [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in group] + [F.col("_task") == F.col("_task_of")])
        place = F.col("_ahead") + F.row_number().over(W.partitionBy(*group, "_task").orderBy("_row"))
        split = split.withColumn("times", F.col("low") + (place <= F.col("more")).cast("bigint"))
        whole = whole.unionByName(split.select(*whole.columns))
    many = F.explode(F.sequence(F.lit(1), F.col("times")))
    return as_before(whole.where("times > 0").withColumn("_epoch", many), docs)


def _fill_sql(source: str, parents: str, name: str, weights: dict) -> str:
    weight = "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {v}" for k, v in weights.get(name, {}).items()) + " ELSE 1 END"
    by = f"PARTITION BY {parents}" if parents else ""
    return f"""(SELECT *, CASE WHEN filled THEN capacity ELSE greatest(0, least(capacity, ((given - first_one.c) * weight) // (w_all - first_one.w))) END::HUGEINT AS budget FROM
        (SELECT *, min(CASE WHEN NOT filled THEN {{'c': c_before, 'w': w_before}} END) OVER ({by}) AS first_one FROM
        (SELECT *, (given - c_before > 0) AND capacity * (w_all - w_before) <= (given - c_before) * weight AS filled FROM
        (SELECT *, coalesce(sum(capacity) OVER before, 0)::HUGEINT AS c_before, coalesce(sum(weight) OVER before, 0)::HUGEINT AS w_before, sum(weight) OVER ({by})::HUGEINT AS w_all FROM
        (SELECT *, ({weight})::HUGEINT AS weight FROM {source})
        WINDOW before AS ({by} ORDER BY capacity::DOUBLE / weight::DOUBLE, {name} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))))"""


DIGEST_SQL = f"""WITH slim AS (SELECT doc_id, 'domain' || ((strpos('0123456789abcdef', substr(md5(coalesce(source, '')), 1, 1)) - 1) % 4) AS domain, lang, source,
    len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::BIGINT AS tokens
    FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS available, count(*) AS docs, (sum(tokens) * {EPOCHS})::HUGEINT AS capacity FROM slim GROUP BY ALL),
total AS (SELECT floor(sum(available)::DOUBLE * {BUDGET_SHARE})::HUGEINT AS given FROM leaves),
doms AS (SELECT * FROM {_fill_sql("(SELECT domain, sum(capacity)::HUGEINT AS capacity, (SELECT given FROM total) AS given FROM leaves GROUP BY domain)", "", "domain", WEIGHTS)}),
langs AS (SELECT * FROM {_fill_sql("(SELECT l.*, d.budget AS given FROM (SELECT domain, lang, sum(capacity)::HUGEINT AS capacity FROM leaves GROUP BY domain, lang) l JOIN doms d USING (domain))", "domain", "lang", WEIGHTS)}),
srcs AS (SELECT * FROM {_fill_sql("(SELECT l.*, d.budget AS given FROM leaves l JOIN langs d USING (domain, lang))", "domain, lang", "source", WEIGHTS)}),
dealt AS (SELECT s.*, b.budget::BIGINT AS budget, b.available, CASE WHEN b.available > 0 THEN least({EPOCHS}, b.budget // b.available) ELSE 0 END::BIGINT AS full_epochs
    FROM slim s JOIN srcs b USING (domain, lang, source)),
placed AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY substr(md5('{SEED}|' || full_epochs || '|' || doc_id), 1, 15), doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM dealt)
SELECT doc_id, domain, lang, source, tokens, budget, (full_epochs + CASE WHEN begun < budget - full_epochs * available THEN 1 ELSE 0 END)::BIGINT AS times,
    (tokens * (full_epochs + CASE WHEN begun < budget - full_epochs * available THEN 1 ELSE 0 END))::BIGINT AS taken_tokens FROM placed"""
