"""Per-key results where a few keys hold most rows: multi-level tree aggregation.

The rows of a key are cut into chunks of a fixed size; each chunk is combined by itself into a state of bounded size, and
states are merged in rounds of ``fan_in`` until one is left per key, so no task ever sees all rows, or all partial states,
of a hot key.

``tree_stats`` merges counts and sums this way. ``tree_select`` finds the exact element of a given rank (the median, say),
which has no small exact state: the merged state is a thinned sorted sample with proven rank bounds; it brackets the
wanted element, the bracket is cut out of the chunks, and the search repeats inside it until it fits one chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import lookup, materialize

#: Elements in a chunk, states merged at once, distance of the sampled elements in a chunk.
CHUNK, FAN_IN, STRIDE = 4096, 8, 8
#: Bits that number the chunks of ``tree_stats``: the lower ones for the place in a partition, the others for the partition.
CHUNK_BITS, PLACE_BITS = 18, 6


def tree_stats(df: DataFrame, keys: Sequence[str], leaf: dict[str, Column], merge: dict[str, str], chunk: int = CHUNK * 16, fan_in: int = 512) -> DataFrame:
    """Mergeable aggregates per key through chunk states, merged in rounds of ``fan_in`` until one is left per key.

    ``leaf`` names the aggregates of raw rows, ``merge`` the SQL aggregate function that merges each (sum, min, max). A
    chunk is ``chunk`` consecutive rows of an input partition, combined in the task that reads it. Each round merges
    neighbouring chunks, so a reducer gets at most ``fan_in`` states of a key; there are as many rounds as the logarithm, to
    the base ``fan_in``, of the 2^CHUNK_BITS chunks that are told apart. Nulls in keys form a key of their own. No rows give no rows.
    """
    at = F.monotonically_increasing_id()
    place, chunks = 1 << PLACE_BITS, 1 << CHUNK_BITS
    states = df.withColumn("__chunk", F.pmod(F.shiftright(at, 33), F.lit(chunks // place)) * place + F.floor(at.bitwiseAND((1 << 33) - 1) / chunk) % place)
    states = states.groupBy(*keys, "__chunk").agg(*[c.alias(n) for n, c in leaf.items()])
    while chunks > 1:
        chunks = -(-chunks // fan_in)
        level = [F.floor(F.col("__chunk") / fan_in).alias("__chunk")] if chunks > 1 else []
        states = states.groupBy(*keys, *level).agg(*[F.expr(f"{f}(`{n}`)").alias(n) for n, f in merge.items()])
    return states


def _merged(states: DataFrame, keys: Sequence[str], chunks: int, stride: int, fan_in: int) -> tuple[DataFrame, int, int]:
    """One thinned sample per key (with the key's n and rank), its stride, and the error of its ranks.

    The element number c of a sample has a rank between stride * c and stride * c + error among the key's elements.
    """
    error = stride - 1
    while chunks > 1:
        states = (
            states.groupBy(*keys, F.floor(F.col("chunk") / fan_in).alias("chunk"))
            .agg(F.array_sort(F.flatten(F.collect_list("sample"))).alias("all"), F.max("n").alias("n"), F.max("rank").alias("rank"))
            .select(*keys, "chunk", F.filter("all", lambda x, i: (i + 1) % fan_in == 0).alias("sample"), "n", "rank")
        )
        stride, error, chunks = stride * fan_in, stride * (fan_in - 1) + fan_in * error, -(-chunks // fan_in)
    return states.select(*keys, "sample", "n", "rank"), stride, error


def tree_select(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rank: Column,
    chunk: int = CHUNK,
    fan_in: int = FAN_IN,
    stride: int = STRIDE,
) -> DataFrame:
    """For each key the element whose rank, counted from 1 in ascending ``order``, is ``rank`` (an expression of ``n``, the
    number of the key's elements).

    The values of ``order`` must differ within a key (put the tie-breaker last); nulls in it come first. Gives the keys,
    the ``order`` columns and ``n``. A rank outside 1..n gives no row for the key; no rows give no rows. The input is read
    twice, so pass it materialised.
    """
    keys, order = list(keys), list(order)
    if chunk < 16 * stride * fan_in:  # else a bracket need not be narrower than what it was taken from
        raise ValueError("chunk must be at least 16 * stride * fan_in")
    counts = tree_stats(df, keys, {"n": F.count(F.lit(1))}, {"n": "sum"})
    counts = materialize(counts.select(*keys, "n", rank.cast("long").alias("rank")))
    # Rows of keys that fit one chunk need not know how many they are.
    cut = materialize(counts.where(F.col("n") > chunk).select(*keys, F.col("n").alias("cut_n"), F.col("rank").alias("cut_rank")))
    element = F.struct(*order).alias("e")
    rows = lookup(df.select(*keys, element), cut, keys, "left")
    number = F.when(F.col("cut_n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("e"), F.ceil(F.col("cut_n") / chunk)))
    leaves = materialize(rows.groupBy(*keys, number.cast("long").alias("chunk"), "cut_n", "cut_rank").agg(F.array_sort(F.collect_list("e")).alias("all")))
    whole = leaves.where("cut_n is null").withColumn("n", F.size("all").cast("long")).withColumn("rank", rank.cast("long"))
    found = _pick(whole, keys, order)
    todo = leaves.where("cut_n is not null").select(*keys, "chunk", "all", F.col("cut_n").alias("n"), F.col("cut_n").alias("m"), F.col("cut_rank").alias("rank"))
    while True:
        widest = todo.agg(F.max("m")).first()[0]
        if widest is None:
            return found
        samples = todo.select(*keys, "chunk", F.filter("all", lambda x, i: (i + 1) % stride == 0).alias("sample"), "n", "rank")
        top, step, error = _merged(samples, keys, -(-widest // chunk), stride, fan_in)
        low = F.floor((F.col("rank") - error - 1) / step).cast("int")
        high = F.ceil(F.col("rank") / step).cast("int")
        bracket = top.select(
            *keys,
            F.when(low >= 1, F.get("sample", low - 1)).alias("lo"),
            F.when(high <= F.size("sample"), F.get("sample", high - 1)).alias("hi"),
        )
        inside = lookup(todo, materialize(bracket), keys).select(
            *keys,
            "chunk",
            "n",
            "rank",
            F.when(F.col("lo").isNull(), F.lit(0)).otherwise(F.size(F.filter("all", lambda x: x <= F.col("lo")))).alias("less"),
            F.filter("all", lambda x: (F.col("lo").isNull() | (x > F.col("lo"))) & (F.col("hi").isNull() | (x <= F.col("hi")))).alias("all"),
        )
        inside = materialize(inside)
        sums = tree_stats(inside, keys, {"gone": F.sum("less"), "m": F.sum(F.size("all"))}, {"gone": "sum", "m": "sum"})
        rest = lookup(inside, materialize(sums), keys).select(*keys, "chunk", "n", (F.col("rank") - F.col("gone")).alias("rank"), "m", "all")
        fits = rest.where(F.col("m") <= chunk).groupBy(*keys, "n", "rank").agg(F.array_sort(F.flatten(F.collect_list("all"))).alias("all"))
        found = found.unionByName(_pick(fits, keys, order))
        # What is still too wide is cut anew into full chunks.
        again = rest.where(F.col("m") > chunk).select(*keys, "n", "rank", "m", F.explode("all").alias("e"))
        todo = materialize(
            again.groupBy(*keys, F.pmod(F.xxhash64("e"), F.ceil(F.col("m") / chunk)).cast("long").alias("chunk"), "n", "rank", "m").agg(F.array_sort(F.collect_list("e")).alias("all"))
        ).select(*keys, "chunk", "all", "n", "m", "rank")


def _pick(sorted_arrays: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    picked = sorted_arrays.withColumn("e", F.get("all", (F.col("rank") - 1).cast("int"))).where("e is not null and rank >= 1")
    return picked.select(*keys, *[F.col(f"e.{c}").alias(c) for c in order], "n")
