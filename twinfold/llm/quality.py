"""Quality classifier: perplexity under a Kneser-Ney model of trusted text, thresholded by language-specific quantiles.

The model (see ngrams.py) runs across word borders and is trained on all texts that the labels call good and not toxic. Every document
gets its perplexity per symbol by sharded count joins; a language's threshold is `slack` times a high quantile of its trusted documents'
(length-smoothed) perplexities, so clean documents stay. Quantiles are exact to one part in ACCURACY ranks of all trusted documents; a
language without trusted ones takes the quantile over all.

Nulls: null or empty text has no symbols, perplexity 0 and is kept; a null language is a language of its own; rows without id are
never trusted. Repeated rows are scored one by one; contradictory labels of an id count as its worst. Without trusted text all is kept.
Very long texts are read in blocks. Only the named columns are read, whatever the others are called. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .common import fresh, hint_small, pinned

ORDER, QUANTILE, SLACK, ACCURACY, PRIOR = 4, 0.99, 1.15, 10_000, 200


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of documents labelled good and never toxic."""
    worst = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return worst.filter("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


def perplexities(documents: DataFrame, labels: DataFrame, order: int = ORDER, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """keep columns, n_symbols, perplexity, trusted of each row."""
    scored = ngrams.score(documents, trusted_ids(labels), order, ("n_target",), keep)
    ppl = F.when(F.col("n_symbols") > 0, F.exp(-F.col("lp0") / F.col("n_symbols"))).otherwise(0.0)
    return scored.select(*keep, "n_symbols", ppl.alias("perplexity"), F.col("target").alias("trusted"))


def classified(documents: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, slack: float = SLACK, prior: int = PRIOR, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """keep columns (lang among them), n_symbols, perplexity, trusted, judged, threshold (null without trusted text) and keep of each row.

    judged is the perplexity with `prior` more symbols of the language's mean: a short text needs more evidence to go.
    """
    rows = pinned(perplexities(documents, labels, order, keep))
    trusted = rows.filter("trusted and n_symbols > 0").withColumn("loss", F.log("perplexity") * F.col("n_symbols"))
    mean = F.sum("loss") / F.sum("n_symbols")
    overall = trusted.agg(mean.alias("mean")).first()["mean"]

    def with_language(left: DataFrame, facts: DataFrame) -> DataFrame:
        facts = pinned(facts.withColumnRenamed("lang", "own_lang"))  # a row a language: sent where they are few, so that no language is one task
        return left.join(hint_small(facts, facts.count()), F.col("lang").eqNullSafe(F.col("own_lang")), "left").drop("own_lang")

    means = trusted.groupBy("lang").agg(mean.alias("own_mean"))
    judged = F.when(F.col("n_symbols") > 0, F.exp((F.log("perplexity") * F.col("n_symbols") + prior * F.coalesce("own_mean", F.lit(overall).cast("double"))) / (F.col("n_symbols") + prior))).otherwise(0.0)
    rows = with_language(rows, means).withColumn("judged", judged).drop("own_mean")
    trusted = rows.filter("trusted and n_symbols > 0")
    cut = F.percentile_approx("judged", quantile, ACCURACY) * slack
    anyone = trusted.agg(cut.alias("cut")).first()["cut"]
    threshold = F.coalesce("own", F.lit(anyone).cast("double"))
    joined = with_language(rows, trusted.groupBy("lang").agg(cut.alias("own")))
    return joined.select(*keep, "n_symbols", "perplexity", "trusted", "judged", threshold.alias("threshold"), F.coalesce(F.col("judged") <= threshold, F.lit(True)).alias("keep"))


def kept(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that the classifier keeps; a row is known by its id, language and the digest of its text."""
    digest, i, lang, t = fresh(documents.columns, "text_md5", "bad_id", "bad_lang", "bad_md5")
    keyed = documents.withColumn(digest, F.unhex(F.md5("text")))
    found = classified(keyed.select("doc_id", "lang", "text", F.col(digest).alias("md5")), labels, keep=("doc_id", "lang", "md5"))
    bad = pinned(found.filter("not keep").select(F.col("doc_id").alias(i), F.col("lang").alias(lang), F.col("md5").alias(t)).distinct())
    same = F.col("doc_id").eqNullSafe(F.col(i)) & F.col("lang").eqNullSafe(F.col(lang)) & (F.col(digest) == F.col(t))
    return keyed.join(hint_small(bad, bad.count()), same, "left_anti").select(*documents.columns)
