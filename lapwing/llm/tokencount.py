"""Token counts from pre-token frequencies.

A task cuts its texts into pre-tokens, counts the frequency of each in each document, has the library count the pieces
of each distinct pre-token once, joins the two and sums. No ids are made for a text. The dictionary of distinct
pre-tokens is the task's own and bounded; nothing is shuffled, so no document, source or pre-token can be hot.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lapwing.llm import arrays as A
from lapwing.llm.pretoken import Counter

LIMIT = 1024


def _count(tokenizer: str, text: str):
    def run(batches):
        counter = Counter(tokenizer, drops_space=False)
        for whole in batches:
            for batch in A.pieces(whole, text):
                n = counter.counts(batch.column(text))
                yield A.of_rows(batch.drop_columns([text]), n_tokens=pa.array(n))

    return run


def count(docs: DataFrame, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """Columns of `docs` but the text, with n_tokens: what the byte-level tokenizer file gives without added tokens.

    Null and empty texts have 0; special strings inside a text count as the library counts them; repeated rows are
    counted each; an empty table stays empty; a column n_tokens of `docs` is replaced. Texts are never cut: one text
    must fit a task. `tokenizer` must be a path that executors can read.
    """
    A.small_batches(docs.sparkSession)
    rows = docs.drop("n_tokens")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text)
    return rows.mapInArrow(_count(tokenizer or public_tokenizers.path("byte_bpe_50k.json"), text), f"{shape}, n_tokens bigint")


def digest(docs: DataFrame) -> DataFrame:
    """Result columns of the contract."""
    slim = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")
    return count(slim).withColumn("over_limit", F.col("n_tokens") > LIMIT)
