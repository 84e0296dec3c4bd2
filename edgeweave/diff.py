"""Comparing two versions of a graph's symbols: matching in tiers, edit scripts, verdicts."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import materialize

#: Tiers of a match, best first, with their confidence. Fixed values of the data model.
TIERS = (("usr", 100), ("signature", 95), ("name", 85), ("fingerprint", 70))


def match(old: DataFrame, new: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(old_id, new_id, tier, confidence): each symbol matched at most once, in the first tier where its key is unique on
    both sides among what earlier tiers left; the remainder has null on the other side and no tier.

    ``old`` and ``new``: id and the tier keys usr, signature, name, fingerprint; a null key matches nothing. ``by`` are
    columns of both that are part of every key and of the result: rows match only where these are the same.
    """
    left, right = old, new
    parts = []
    for tier, confidence in TIERS:
        def single(df: DataFrame, name: str) -> DataFrame:
            g = df.where(F.col(tier).isNotNull()).groupBy(*by, F.col(tier).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias(name))
            return g.where("n = 1").select(*by, "key", name)

        hit = single(left, "old_id").join(single(right, "new_id"), [*by, "key"]).select(*by, "old_id", "new_id", F.lit(tier).alias("tier"), F.lit(confidence).alias("confidence"))
        hit = materialize(hit)  # each tier reads all earlier ones: their plans would grow with every tier
        parts.append(hit)
        left = materialize(left.join(hit.select(*by, F.col("old_id").alias("id")), [*by, "id"], "left_anti"))
        right = materialize(right.join(hit.select(*by, F.col("new_id").alias("id")), [*by, "id"], "left_anti"))
    none = F.lit(None)
    parts.append(left.select(*by, F.col("id").alias("old_id"), none.cast("long").alias("new_id"), none.cast("string").alias("tier"), F.lit(0).alias("confidence")))
    parts.append(right.select(*by, none.cast("long").alias("old_id"), F.col("id").alias("new_id"), none.cast("string").alias("tier"), F.lit(0).alias("confidence")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_EDIT = T.StructType([T.StructField("op", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in ("old_at", "old_end", "new_at", "new_end")]])


@F.pandas_udf(T.ArrayType(_EDIT))
def edit_script(old: pd.Series, new: pd.Series) -> pd.Series:
    """The edits from one array of lines to another: insert, delete, replace, with ranges on both sides."""

    def one(a, b):
        a, b = list(a) if a is not None else [], list(b) if b is not None else []
        return [(op, i, j, k, m) for op, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if op != "equal"]

    return pd.Series([one(a, b) for a, b in zip(old, new)])


def verdict(equal, comparable):
    """same, different, or unknown where the two cannot be compared; columns in, column out."""
    return F.when(~comparable | comparable.isNull(), "unknown").when(equal, "same").otherwise("different")
