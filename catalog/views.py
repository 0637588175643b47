"""DuckDB text of the views in lapwing/plans/tables.py, used as common table expressions by the oracles."""

VIEWS = {
    "items": """items AS (SELECT e.vec_id AS item_id, 'c' || e.label AS category, coalesce(d.source,'none') AS subcategory,
        e.embedding::DOUBLE[] AS embedding FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id)""",
    # takes the place of `items`: only labelled documents have a category
    "items_partial": """items AS (SELECT e.vec_id AS item_id, CASE WHEN l.doc_id IS NOT NULL THEN d.lang || '-' || d.source END AS category,
        coalesce(d.source,'none') AS subcategory, e.embedding::DOUBLE[] AS embedding FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id
        LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id)""",
    "doc_items": """doc_items AS (SELECT doc_id AS item_id, lang AS category, source AS subcategory, text FROM documents)""",
    "ev": """ev AS (SELECT event_id, user_id, event_type, value, ts, CAST(json_extract_string(props,'$.k') AS BIGINT) AS item_id,
        CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 6.0) AS BIGINT) AS bucket FROM events)""",
    "log": """log AS (SELECT *, CASE WHEN event_type='click' THEN 1 ELSE 0 END::BIGINT AS label FROM ev
        WHERE event_type IN ('click','view'))""",
    "impr": """impr AS (SELECT user_id*1048576+bucket AS impression_id, user_id, bucket, item_id, max(label) AS label, max(ts) AS "time"
        FROM log GROUP BY user_id, bucket, item_id)""",
    "heads": """heads AS (SELECT user_id*1048576+bucket AS impression_id, user_id, bucket, max(ts) AS "time" FROM log GROUP BY user_id, bucket)""",
    "clicks": """clicks AS (SELECT user_id, bucket, ts, event_id, item_id,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM log WHERE label = 1)""",
    "hist": """hist AS (SELECT h.impression_id, h.user_id, h.bucket, c.pos, c.item_id FROM heads h JOIN clicks c
        ON c.user_id = h.user_id AND c.bucket < h.bucket)""",
    "ae": """ae AS (SELECT DISTINCT l_orderkey AS article_id, l_partkey AS entity_id FROM lineitem)""",
    "articles": """articles AS (SELECT o_orderkey AS article_id, o_orderpriority AS category, o_orderstatus AS subcategory,
        o_orderdate AS "time" FROM orders)""",
    "evec": """evec AS (SELECT vec_id AS entity_id, embedding::DOUBLE[] AS vec FROM embeddings)""",
}
NEEDS = {
    "log": ["ev"],
    "impr": ["ev", "log"],
    "heads": ["ev", "log"],
    "clicks": ["ev", "log"],
    "hist": ["ev", "log", "heads", "clicks"],
}


def sql(views: str, body: str, extra: str = "", recursive: bool = False) -> str:
    """WITH <views and what they need>, <extra> <body>."""
    order: list[str] = []
    for name in views.split():
        for need in [*NEEDS.get(name, []), name]:
            if need not in order:
                order.append(need)
    parts = [VIEWS[n] for n in order]
    if extra:
        parts.append(extra.strip().rstrip(","))
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + body


class Catalog(dict):
    """name -> (query function, oracle SQL or None)."""

    def add(self, name: str, oracle: str | None = None):
        def register(fn):
            if name in self:
                raise KeyError(f"query {name} registered twice")
            self[name] = (fn, oracle)
            return fn

        return register
