"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections, by DataFrame functions alone.

Leaves are pieces of a paragraph (a line): runs up to 96 characters or a sentence end, so that the text is exactly the pieces and line
ends in order. A paragraph's node is a hash of its text, with its pieces' hashes beside it; a section ends after a paragraph whose node
ends in 0 or 1 (one in eight), wherever it stands, so an edit moves no other section's border; a section's node hashes its paragraphs'
entries, and the root hashes the sections' nodes. Equal roots mean equal texts; differing sections, paragraphs and pieces locate edits.

The fingerprint is one string: `root#sections`, sections joined by `|`, paragraphs by `;`, each `pieces:node` with 12 hex digits a piece.
Null text is empty; an empty text has one empty paragraph. Ids are whole numbers; null ids sort last; rows of equal id sort by text (by its
md5 first where they fill several ranges); repeated rows are kept. Very long texts are one value each, as in the table. Only the named
columns are read, whatever the others are called. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hint_small

PIECE = r"[^.!?]{1,96}+[.!?]*+|[.!?]++"
ROWS_PER_BUCKET = 500


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is computed once, however often and in whatever loops body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def fingerprint(text: Column) -> Column:
    """The fingerprint string of a text column."""
    piece = lambda x: F.substring(F.md5(x), 1, 12)
    entry = lambda p: F.concat(F.array_join(F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), piece), ""), F.lit(":"), F.md5(p))
    tree = F.regexp_replace(F.array_join(F.transform(F.split(text, "\n", -1), entry), ";"), "([01]);", "$1|")
    return let(tree, lambda t: F.concat(root_of(t), F.lit("#"), t))


def root_of(tree: Column) -> Column:
    """The root over a tree's sections."""
    return F.sha2(F.array_join(F.transform(F.split(tree, r"\|"), lambda s: F.sha2(s, 256)), ""), 256)


def root(fingerprint_: Column) -> Column:
    return F.substring(fingerprint_, 1, 64)


def leaves(fingerprint_: Column) -> Column:
    """Pieces' hashes of a fingerprint, repeated ones numbered, as longs: equal sets mean equal multisets of pieces."""
    hashes = F.regexp_extract_all(F.regexp_replace(F.substring(fingerprint_, 66, 1 << 30), ":[0-9a-f]{32}[;|]?", ""), F.lit("[0-9a-f]{12}"), F.lit(0))
    ordered = F.sort_array(F.transform(hashes, lambda h: F.conv(h, 16, 10).cast("long")))

    def numbered(ordered: Column) -> Column:
        # equal hashes stand together: each run is numbered from its own start
        starts = F.filter(F.transform(ordered, lambda h, i: F.when((i == 0) | (F.get(ordered, i - 1) != h), i).otherwise(F.lit(-1))), lambda i: i >= 0)
        return let(starts, lambda s: F.flatten(F.transform(s, lambda at, k: run(ordered, at, F.coalesce(F.get(s, k + 1), F.size(ordered))))))

    def run(ordered: Column, start: Column, end: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), end - start - 1), lambda k: F.when(k == 0, F.get(ordered, start)).otherwise(F.xxhash64(F.get(ordered, start), k)))

    return let(ordered, numbered)


def likeness(a: Column, b: Column) -> Column:
    """Twice the shared pieces by all pieces of two leaves() columns: 1 for equal multisets, 0 for none shared; 1 if both are empty."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def differing_sections(a: Column, b: Column) -> Column:
    """Sections of fingerprint a that b doesn't have: where a was edited."""
    sections = lambda x: F.split(F.substring(x, 66, 1 << 30), r"\|")
    return F.array_except(sections(a), sections(b))


def with_next(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """doc_id, text (null: empty) and next_text, that of the next row by ascending doc_id; after the last comes the first.

    Ids (whole numbers) are dealt into ranges of about equal rows; a range's texts are shuffled once and ordered inside it, and the first
    row of each range is also sent to the range before, so no range depends on another task. An id that would fill ranges by itself has one
    of its own, and like that of the null ids it is split by the texts' md5, by which its rows then come. There are at most 16,384 ranges
    before that: of a larger table they are larger.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = rows.select(F.col("doc_id").cast("long").alias("doc_id"))
    n = ids.count()
    ranges = max(1, min(1 << 14, math.ceil(n / rows_per_bucket)))
    found = ids.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    found = Counter(int(x) for x in found)
    edges = sorted({*found, *(x + 1 for x, times in found.items() if times > 1)})
    bounds = F.split(F.lit(",".join(map(str, edges))), ",").cast("array<bigint>") if edges else F.array().cast("array<bigint>")
    steps = [1 << k for k in range(len(edges).bit_length() - 1, -1, -1)] if edges else []
    # the number of edges that are not above the id, by halving
    bucket = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= F.col("doc_id"), at + step).otherwise(at)) if steps else F.lit(0)
    last = len(edges) + 1  # null ids have a range of their own, the last
    dealt = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), last).otherwise(bucket))
    one_id = F.min("doc_id").eqNullSafe(F.max("doc_id"))
    parts = F.when(one_id, F.ceil(F.count("*") / (2 * rows_per_bucket))).otherwise(1).cast("int")
    sizes = dealt.groupBy("bucket").agg(parts.alias("parts"))
    md5 = F.md5("text")
    part = F.floor(F.conv(F.substring(md5, 1, 6), 16, 10).cast("long") * F.col("parts") / F.lit(1 << 24)).cast("int")
    split = F.col("parts") > 1
    dealt = dealt.join(hint_small(sizes, ranges), "bucket").select("doc_id", "text", "bucket", F.when(split, part).otherwise(0).alias("part"), F.when(split, md5).alias("digest"))
    first = dealt.groupBy("bucket", "part").agg(F.min(F.struct("doc_id", "digest")).alias("first"), F.max(F.struct("bucket", "part")).alias("own"))  # one row a range
    ordered = first.withColumn("before", F.lag("own").over(Window.partitionBy(F.lit(0)).orderBy("bucket", "part")))
    top = first.agg(F.max("own").alias("top"))
    heads = ordered.crossJoin(F.broadcast(top)).select(F.col("bucket").alias("of_bucket"), F.col("part").alias("of_part"), "first", F.coalesce("before", "top").alias("before"))
    same = (F.col("bucket") == F.col("of_bucket")) & (F.col("part") == F.col("of_part")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("digest").eqNullSafe(F.col("first.digest"))
    guests = dealt.join(hint_small(heads, ranges), same).select("doc_id", "text", "before.bucket", "before.part", "digest", F.lit(1).alias("guest"))
    guests = guests.filter("digest is null").unionByName(guests.filter("digest is not null").dropDuplicates(["bucket", "part", "digest"]))  # copies are alike
    both = dealt.withColumn("guest", F.lit(0)).unionByName(guests)
    order = Window.partitionBy("bucket", "part").orderBy("guest", F.col("doc_id").asc_nulls_last(), "digest", "text")
    following = both.withColumn("next_text", F.lead("text").over(order)).filter("guest = 0")
    return following.select("doc_id", "text", "next_text")


def edited(text: Column, other: Column) -> Column:
    """text with its last half (rounded down) replaced by as many first characters of other, or all it has."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def fingerprints(documents: DataFrame) -> DataFrame:
    """The contract's columns, one row per document."""
    rows = with_next(documents).withColumn("edited_text", edited(F.col("text"), F.col("next_text")))
    marked = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited_text")).alias("edited_fingerprint"), leaves(fingerprint(F.col("next_text"))).alias("next_leaves"))
    own = marked.withColumn("own_leaves", leaves(F.col("fingerprint"))).withColumn("edited_leaves", leaves(F.col("edited_fingerprint")))
    return own.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("own_leaves"), F.col("edited_leaves")).alias("near_edited"), likeness(F.col("own_leaves"), F.col("next_leaves")).alias("near_next"),
        root(F.col("fingerprint")).alias("root"),
    )
