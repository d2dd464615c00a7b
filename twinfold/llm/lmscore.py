"""Language-model scoring by cross-entropy difference.

Two Kneser-Ney models of one order (see ngrams.py), a target model of trusted documents and a background model of all documents, share
one vocabulary: the symbols of all documents. A document's score is its cross-entropy per symbol under the target less that under the
background; low scores are like the target. All documents are counted, in one pass for both models.

Nulls: null or empty text has no symbols and score 0; a null id is never a target. Repeated rows are counted and scored one by one.
Without a target text the target model has no counts and gives each symbol the uniform probability. Very long texts are read in blocks.
Only the named columns are read, whatever the others are called. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .quality import trusted_ids

ORDER = 5


def scored(documents: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_symbols, target_loss, background_loss (per symbol) and score of each row."""
    rows = ngrams.score(documents, trusted_ids(labels), order, ("n_target", "n"), vocabulary="n")
    loss = [F.when(F.col("n_symbols") > 0, -F.col(c) / F.col("n_symbols")).otherwise(0.0) for c in ("lp0", "lp1")]
    return rows.select("doc_id", "n_symbols", loss[0].alias("target_loss"), loss[1].alias("background_loss"), (loss[0] - loss[1]).alias("score"))
