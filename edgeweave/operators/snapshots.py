"""What changed between consecutive full snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import lookup, materialize


def plain_path(path: Column) -> Column:
    """A path with forward single slashes and without ``.`` and ``..`` parts; ``..`` at the root stays there.

    Spelled plainly already, it passes through; only other spellings are taken apart. Null stays null.
    """
    slashed = F.translate(path, "\\", "/")
    parts = F.filter(F.split(slashed, "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x != "..", F.concat(acc, F.array(x))).otherwise(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))),
    )
    root = F.when(slashed.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"\\|//|/\.{1,2}(/|$)|^\.{1,2}(/|$)|./$"), F.concat(root, F.array_join(kept, "/"))).otherwise(path)


def snapshot_changes(df: DataFrame, snapshot: str, keys: Sequence[str], value: str) -> DataFrame:
    """(snapshot, keys, change) for every record ``added``, ``removed`` or ``changed`` against the preceding snapshot.

    The rows of a snapshot are a set of (keys, value): repeated rows count once, and null is a value like any other, in
    keys too. The preceding snapshot is the next smaller number that exists; the first one has no rows. Rows without a
    snapshot number belong to none. Of several values under one key in a snapshot, the key is ``changed`` if the sets
    differ. An empty table gives no rows.

    EXCEPT ALL both ways, for all pairs of neighbours at once: rows carry the number of the pair, in which each snapshot is
    once the later and once the earlier one. What is compared are 128-bit hashes of key and row, 36 bytes whatever the
    record. The residues are joined fully outer by the hash of the key, which labels them, and only then does the scan give
    them their keys back. Two of 10^12 different rows share a hash with a probability of 10^-14.
    """
    keys = list(keys)
    rows = df.where(F.col(snapshot).isNotNull())
    # Hashes skip nulls, so whether a column is null is hashed, too.
    parts = lambda cols: [x for c in cols for x in (F.col(c), F.col(c).isNull())]
    wide = lambda cols, name: [F.xxhash64(*parts(cols)).alias(f"{name}1"), F.xxhash64(F.lit(name), *parts(reversed(cols))).alias(f"{name}2")]
    hashed = materialize(rows.select(F.col(snapshot).alias("__s"), *wide(keys, "k"), *wide([*keys, value], "r")).distinct())
    numbers = materialize(hashed.select("__s").distinct())
    places = materialize(numbers.select("__s", (F.row_number().over(Window.orderBy("__s")) - 1).alias("__at")))
    last = places.count() - 1
    cells = ["k1", "k2", "r1", "r2"]
    placed = materialize(lookup(hashed, places, ["__s"]).select("__at", *cells))
    cur = placed.where("__at > 0")
    old = placed.where(F.col("__at") < last).select((F.col("__at") + 1).alias("__at"), *cells)
    # Of several values under one key, the key counts once on each side.
    side = lambda a, b, flag: a.exceptAll(b).select("__at", "k1", "k2").distinct().withColumn(flag, F.lit(True))
    both = side(cur, old, "new").join(side(old, cur, "gone"), ["__at", "k1", "k2"], "full_outer")
    label = F.when(F.col("new") & F.col("gone"), "changed").when(F.col("new"), "added").otherwise("removed")
    changes = materialize(both.select("__at", "k1", "k2", label.alias("change")))
    # The key itself comes from any row that has it.
    wanted = changes.select("k1", "k2").distinct()
    named = rows.select(*wide(keys, "k"), *keys).join(wanted, ["k1", "k2"], "left_semi").distinct()
    out = changes.join(named, ["k1", "k2"])
    return lookup(out, places, ["__at"]).select(F.col("__s").alias(snapshot), *keys, "change")
