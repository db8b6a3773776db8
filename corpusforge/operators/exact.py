"""Exact dedup at three levels; the first document of each class in input order wins."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.functions.text import WS, casefold, one_space
from corpusforge.session import materialize

LEVELS = ("raw", "normalized", "structural")
_PUNCTUATION = rf"[^\p{{L}}\p{{N}}_{WS}]"
#: Runs of it, as white space is folded next. Java tries the members of a class one by one, so ASCII comes first.
_SEPARATORS = rf"[\x00-\x08\x0e-\x1b!-/:-@\[-^`{{-\x84\x86-\x9f[\xa1-\x{{10ffff}}&&{_PUNCTUATION}]]+"


def comparable(c: Column, level: str) -> Column:
    """What the hash of a level is taken of. Combining marks count as punctuation."""
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}: one of {', '.join(LEVELS)}")
    if level == "raw":
        return c
    c = F.regexp_replace(casefold(c), _SEPARATORS, " ")
    if level == "structural":
        c = F.regexp_replace(c, r"\p{Nd}+", "0")
    return F.btrim(one_space(c))


def signature(c: Column, level: str = "normalized") -> Column:
    return F.md5(comparable(c, level).cast("binary"))


def signatures(c: Column) -> Column:
    """Struct of all three."""
    return F.struct(*[signature(c, level).alias(level) for level in LEVELS])


@F.pandas_udf(T.StringType())
def blake2b_128(s: pd.Series) -> pd.Series:
    """128-bit blake2b hex, for signatures that must agree with other tools; give it ``comparable``."""
    return s.map(lambda t: hashlib.blake2b(t.encode(), digest_size=16).hexdigest(), na_action="ignore")


def mark_exact(df: DataFrame, text: str = "text", ord_: str = "ord", key: str | None = None, level: str = "normalized") -> DataFrame:
    """Adds ``signature``, ``is_duplicate``, ``first_ord`` and ``first_key``.

    Texts are normalized and hashed once; ordinals and hashes are written. The winners
    are an aggregate with partial results for each hash, so a hash that a third of the
    rows share is one small row. ``ord_`` names a row, and texts join their row's result.
    """
    key = key or ord_
    x = df.select(F.col(ord_).alias("o"), F.col(key).alias("k"), signature(F.col(text), level).alias("signature"))
    x = materialize(x, "signed")
    first = x.groupBy("signature").agg(F.min(F.struct("o", "k")).alias("f"))
    marked = x.join(first, "signature").select(F.col("o").alias(ord_), "signature", (F.col("o") != F.col("f.o")).alias("is_duplicate"), F.col("f.o").alias("first_ord"), F.col("f.k").alias("first_key"))
    return df.join(marked, ord_).select(*df.columns, "signature", "is_duplicate", "first_ord", "first_key")


def duplicate_classes(df: DataFrame, text: str = "text", ord_: str = "ord", level: str = "normalized") -> DataFrame:
    """A row for each class: signature, first_ord, copies."""
    x = df.select(signature(F.col(text), level).alias("signature"), F.col(ord_).alias("o"))
    return x.groupBy("signature").agg(F.min("o").alias("first_ord"), F.count(F.lit(1)).alias("copies"))
