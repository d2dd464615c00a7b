"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's features are the hashed byte n-grams (2 to 4, with word borders, A-Z lowered) of all its words. Their embeddings are averaged and
a linear softmax gives the languages' probabilities. Embeddings and weights are trained by stochastic gradient descent in numpy on
about `per_language` labelled documents a language (the documented bound; which ones is settled by a hash of the id), of which a fifth
calibrates the softmax's temperature and the score below which a prediction is rejected. Spark extracts the sample's features, at most
BUCKETS numbers a document, and predicts all documents in their partitions; the model is BUCKETS x languages numbers. A language has an
equal part of MOST_FEATURES: of one whose documents are so long that `per_language` of them could have more, fewer are drawn.

Nulls: a null text, or one without a letter, is `und` with score 0 and rejected. Rows with null id or label teach nothing. If no row can
teach, everything is `und`. Repeated rows are predicted one by one, very long texts whole. Only the named columns are read; `keep` columns
are carried along whatever they are called. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, mapped, mix64

BUCKETS, DIM, ORDERS = 1 << 14, 16, (2, 3, 4)
PER_LANGUAGE, MOST_LANGUAGES = 500, 500
MOST_FEATURES = 1 << 26  # of the sample, 8 bytes each where they are gathered
MAYBE = re.compile(r"[^\W\d_]")  # letters, and numerals that aren't decimal digits


def has_letter(text: str) -> bool:
    """Whether the text has a character of the Unicode categories L*."""
    return any(m[0].isalpha() for m in MAYBE.finditer(text))



def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, bucket) of each subword of the words."""
    flat = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8)
    space = np.cumsum(flat == 32)
    hashed, owners, buckets = np.zeros(len(flat), dtype=np.uint64), [], []
    for n in range(1, max(ORDERS) + 1):
        m = len(flat) - n + 1
        if m < 1:
            break
        hashed = hashed[:m] * np.uint64(0x100000001B3) + flat[n - 1 :].astype(np.uint64) + np.uint64(1)
        if n in ORDERS:
            # no space inside: only at the first or last place, as the word's border
            ok = np.flatnonzero((space[n - 2 : n - 2 + m] if n > 1 else space[:m]) == space[:m])
            owners.append(space[ok] - 1)
            buckets.append((mix64(hashed[ok] * np.uint64(7) + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(owners) if owners else np.zeros(0, np.int64), np.concatenate(buckets) if buckets else np.zeros(0, np.int64)


@dataclass
class Model:
    """languages, the table of logits by bucket, bias, temperature and the score below which a prediction is rejected."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(best language's number, its probability) of each text."""
        index: dict[bytes, int] = {}
        ids: list[int] = []
        ends = []
        for x in texts:
            for w in x.lower().split():
                ids.append(index.setdefault(w, len(index)))
            ends.append(len(ids))
        owner, bucket = subwords(list(index))
        per_word = np.stack([np.bincount(owner, weights=self.logits[bucket, c], minlength=len(index)) for c in range(len(self.languages))] + [np.bincount(owner, minlength=len(index)).astype(float)], axis=1) if index else np.zeros((0, len(self.languages) + 1))
        total = np.concatenate([np.zeros((1, per_word.shape[1])), np.cumsum(per_word[np.array(ids, np.int64)], axis=0)])
        ends = np.array([0, *ends])
        sums = total[ends[1:]] - total[ends[:-1]]
        z = (sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.bias) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], check: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 0.5, seed: int = 11) -> Model | None:
    """A model from (language, buckets, their shares) of documents; `check` calibrates it."""
    languages = sorted({x[0] for x in rows})
    if not languages:
        return None
    rng, number = np.random.default_rng(seed), {x: i for i, x in enumerate(languages)}
    e, w, b = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, len(languages))), np.zeros(len(languages))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) + 0.01
        for k in rng.permutation(len(rows)):
            y, at, share = rows[k]
            h = share @ e[at]
            z = h @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[number[y]] -= 1
            e[at] -= (step * 20) * share[:, None] * (w @ p)[None, :]
            w -= step * np.outer(h, p)
            b -= step * 0.1 * p
    model = Model(languages, e @ w, b)
    check = [x for x in check if x[0] in number]
    if check:
        z = np.stack([share @ model.logits[at] + b for _, at, share in check])
        y = np.array([number[x[0]] for x in check])

        def loss(t: float) -> float:
            s = z / t - (z / t).max(axis=1, keepdims=True)
            return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

        model.temperature = min(np.geomspace(0.05, 20, 80), key=loss)
        s = z / model.temperature
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
        # below what nearly every right prediction reaches, with a margin, and never above an even guess between two
        model.reject_below = float(min(0.5, 0.9 * right[int(0.001 * len(right))])) if len(right) else 0.0
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, per_language: int = PER_LANGUAGE, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", most_languages: int = MOST_LANGUAGES, most_features: int = MOST_FEATURES) -> Model | None:
    """A model learned from text and language of documents that are not held out: about `per_language` of each of the `most_languages` commonest.

    most_features bounds what the sample may have, a document's features being at most BUCKETS and three for each byte and border.
    """
    fold = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5
    known = documents.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter((fold != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    features = F.sum(F.least(F.lit(BUCKETS), 3 * (F.octet_length("text") + 2)).cast("long"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), features.alias("features")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()  # one row a language
    if not counts:
        return None
    part = most_features / len(counts)
    share = F.create_map(*[F.lit(x) for r in sorted(counts, key=lambda r: r["lang"]) for x in (r["lang"], min(1.0, per_language / r["n"], part / r["features"]))])
    drawn = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)) * (1 << 20))
    schema = "lang string, checks boolean, at array<int>, share array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, share = [], []
            for x in as_bytes(b.column(2)):
                _, bucket = subwords(x.lower().split())
                found, n = np.unique(bucket, return_counts=True)
                at.append(found.astype(np.int32)), share.append((n / max(1, n.sum())).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))], ["lang", "checks", "at", "share"])

    rows = mapped(drawn.select("lang", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1).alias("checks"), "text"), run, schema).toArrow()
    parts: dict[bool, list] = {True: [], False: []}
    for y, c, at, share in zip(rows["lang"].to_pylist(), rows["checks"].to_pylist(), rows["at"], rows["share"], strict=True):
        if len(at):
            parts[c].append((y, at.values.to_numpy().astype(np.int64), share.values.to_numpy().astype(np.float64)))
    order = lambda x: (x[0], len(x[1]), float(x[2].max()), int(x[1].sum()))  # noqa: E731  whatever order the rows came in
    return train(sorted(parts[False] or parts[True], key=order), sorted(parts[True], key=order))


def predict(documents: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str, str] = ("lang_pred", "score", "accepted")) -> DataFrame:
    """keep columns, then (by `names`) the language, its score and whether it is accepted (no: the score is below the calibrated threshold)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers
    schema = T.StructType([*documents.select(*keep).schema.fields, *(T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True))])
    at = keep.index(text) if text in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 300):
                part = b.slice(lo, 300)
                texts = as_bytes(part.column(at))
                has = [model is not None and has_letter(x.decode("utf-8", "replace")) for x in texts]
                best, p = model.scores(texts) if model is not None else ([0] * len(texts), [0.0] * len(texts))
                lang = [model.languages[k] if ok else "und" for k, ok in zip(best, has, strict=True)]
                score = [float(x) if ok else 0.0 for x, ok in zip(p, has, strict=True)]
                accepted = [ok and x >= model.reject_below for x, ok in zip(score, has, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], schema.names)

    read = documents.select(*keep) if text in keep else documents.select(*keep, F.col(text).alias("__text"))
    return mapped(read, run, schema)


def identified(documents: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The contract's columns."""
    found = predict(documents, fit(documents, per_language))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
