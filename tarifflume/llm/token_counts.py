"""Token counts of texts under a public vocabulary."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifflume.llm.common import ship
from tarifflume.llm.vocabulary import SharedVocabulary


def token_counts(docs: DataFrame, limit: int = 2048, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row of `docs`.

    Pre-tokens that the vocabulary holds whole are counted by a table lookup, the others merged
    (see `vocabulary`). Whole texts, no shuffle: a lost task is just run again. A null text is
    empty (0 bytes, 0 tokens); rows with null or repeated doc_id are counted like any other; an
    empty table gives no rows; other columns of `docs` are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    vocabulary = SharedVocabulary(spark, path)

    def count(batches):
        coder = vocabulary.coder()
        for batch in batches:
            texts = batch.column(1)
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(coder.counts(texts))], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
