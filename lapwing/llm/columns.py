"""Tables whose columns may be called like those that an operator adds."""

from __future__ import annotations

from pyspark.sql import DataFrame


def by_place(docs: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """`docs` with columns named by their place, and the new names of those wanted."""
    names = [f"column_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), [names[docs.columns.index(w)] for w in wanted]


def as_before(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of a table named by place with the columns of `docs` alone."""
    return rows.select(*[f"column_{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
