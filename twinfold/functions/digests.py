"""Canonical digests of rows: SHA-256 of JSON with sorted keys and no spaces, as Python writes it.

Spark's own to_json prints floats and non-ASCII letters in another way. `canonical_text` builds the text from column expressions for all types
but floating numbers, whose shortest digits Java 17 doesn't always find: for these there is an Arrow-batched UDF. `native_hash` is a JVM-side
identity for rows whose digest nobody outside Spark has to reproduce.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(value: object) -> str:
    """SHA-256 of a value's canonical JSON. NaN and infinities raise."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


@F.pandas_udf(T.StringType())
def canonical_json_digest(text: pd.Series) -> pd.Series:
    """Digest of a JSON text after canonical re-writing; null stays null."""
    return text.map(lambda x: None if x is None else canonical(json.loads(x)))


#: Short escapes of JSON: fixed values.
ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def json_string(text: Column) -> Column:
    """A text as a JSON string in ASCII: short escapes where there are some, else \\uXXXX for each UTF-16 unit outside space to tilde.

    The text is cut into runs that stand as they are and single other characters; only these are rewritten.
    """
    plain = r"[ !#-\[\]-~]+"
    parts = F.regexp_extract_all(text, F.lit(rf"{plain}|[^ !#-\[\]-~]"), F.lit(0))

    def written(part: Column) -> Column:
        short = F.create_map(*(F.lit(x) for pair in ESCAPES.items() for x in pair))
        units = F.regexp_replace(F.lower(F.hex(F.encode(part, "UTF-16BE"))), "(.{4})", r"\\u$1")
        return F.when(F.regexp_like(part, F.lit(rf"^{plain}\z")), part).otherwise(F.coalesce(F.try_element_at(short, part), units))

    return F.concat(F.lit('"'), F.array_join(F.transform(parts, written), ""), F.lit('"'))


def canonical_text(value: Column, kind: T.DataType) -> Column:
    """A value's canonical JSON as `canonical` hashes it: keys in order, no spaces, nulls as null.

    Texts, whole numbers, booleans, and arrays, structs and text-keyed maps of these; other types (floating numbers, dates) raise.
    """
    if isinstance(kind, T.StringType):
        text = json_string(value)
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        text = value.cast("string")
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_text(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        keys = F.sort_array(F.map_keys(value))
        pairs = F.transform(keys, lambda k: F.concat(json_string(k), F.lit(":"), canonical_text(F.element_at(value, k), kind.valueType)))
        text = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    elif isinstance(kind, T.StructType):
        fields = [F.concat(F.lit(json.dumps(f.name) + ":"), canonical_text(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        text = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    else:
        raise TypeError(f"{kind.simpleString()} has no canonical text here; canonical_json_digest takes JSON of any kind")
    return F.when(value.isNull(), F.lit("null")).otherwise(text)


def canonical_digest(df: DataFrame, columns: Iterable[str]) -> Column:
    """SHA-256 of the canonical JSON of a row's columns, as one object."""
    kinds = T.StructType([df.schema[c] for c in columns])
    return F.sha2(canonical_text(F.struct(*kinds.names), kinds), 256)


def native_hash(columns: Iterable[Column]) -> Column:
    """SHA-256 over the columns' strings with lengths, nulls apart from empty strings."""
    part = lambda c: F.when(c.isNull(), "n;").otherwise(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"), F.lit(";")))
    return F.sha2(F.concat(*map(part, columns)), 256)
