"""Mixing sources to target weights: temperature mixing realised as budgeted block permutations.

Weights are powers of the sources' natural token shares. Towards given target shares, a source moves on the path
p^(1-t) * q^t from its natural share p to its target share q, and t is bisected to the largest that its repetition limit
allows (``mix_plan``): at t = 1 it reaches its target, a source that stops before is limited. Without targets, one exponent
for all sources is bisected until the weights have a wanted entropy (``temperature_plan``); what sources at their
repetition limit cannot take is filled into the others. Either plan gives budgets in tokens.

A source's budget is realised pass by pass: each pass permutes the source's documents by a keyed hash. Whole passes take
everything; in the last one, blocks of the permutation (documents whose keys begin alike) are taken in order while the
budget lasts, and the block where it ends is divided again until it is small enough to be filled document by document.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import lookup, materialize

#: Documents of the block that is filled one by one; bits by which a block is divided; candidates tried at once in a bisection.
BLOCK_DOCS, BLOCK_BITS, WIDTH = 4096, 12, 33

_PLAN_ARROW = pa.schema(
    [("source", pa.string()), ("target_share", pa.float64()), ("max_repeats", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64()), ("exponent", pa.float64()), ("weight", pa.float64()), ("budget", pa.int64()), ("limited", pa.bool_())]
)
PLAN = "source string, target_share double, max_repeats bigint, docs bigint, tokens bigint, exponent double, weight double, budget bigint, limited boolean"
_NAMES = _PLAN_ARROW.names


@dataclass(frozen=True)
class Mix:
    """``plan``: a row per source of the mix. ``total``: tokens of all documents, those without a source included."""

    plan: DataFrame
    total: int


def source_label(column: Column) -> Column:
    """One spelling per source: labels are the same if they differ in case, outer blanks, or ``-``, blank and ``_`` only."""
    return F.translate(F.lower(F.trim(column)), "- ", "__")


def bisect_exponent(fits: Callable[[float], bool], low: float = 0.0, high: float = 1.0, rounds: int = 60) -> float:
    """The largest exponent in [low, high] that ``fits``, which holds up to some exponent and not beyond; low if none does."""
    if fits(high):
        return high
    for _ in range(rounds):
        middle = (low + high) / 2
        low, high = (middle, high) if fits(middle) else (low, middle)
    return low


def source_weight(share: float, target: float, max_repeats: int) -> tuple[float, float]:
    """(exponent, weight) of one source: as far from its natural share towards its target as ``max_repeats`` uses allow.

    Shares within a rounding error of the limit count as beyond it, so an exponent of 1 is proof that the target is met.
    """
    if share <= 0 or target <= 0 or max_repeats <= 0:
        return 0.0, 0.0
    t = bisect_exponent(lambda t: share * (target / share) ** t <= max_repeats * share * (1 - 1e-12))
    return t, target if t == 1 else share * (target / share) ** t


def _sources(documents: DataFrame, targets: DataFrame) -> tuple[DataFrame, int]:
    """(source, label, share, repeats, docs, tokens) of the mix, and the tokens of all documents."""
    spec = targets.where("source is not null").groupBy(source_label(F.col("source")).alias("label")).agg(
        F.min("source").alias("source"), F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.min(F.coalesce("max_repeats", F.lit(0))).cast("long").alias("repeats")
    )
    got = materialize(documents.groupBy(source_label(F.col("source")).alias("label")).agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens")))
    total = got.agg(F.sum("tokens")).first()[0] or 0
    zero = F.lit(0).cast("long")
    return spec.join(got, "label", "left").select("source", "label", "share", "repeats", F.coalesce("docs", zero).alias("docs"), F.coalesce("tokens", zero).alias("tokens")), total


def mix_plan(documents: DataFrame, targets: DataFrame) -> Mix:
    """Budgets of the sources in ``targets`` (source STRING, target_share DOUBLE, max_repeats INT) over ``documents``
    (doc_id, source, n_tokens): every source reaches its target share of all tokens, or its repetition limit.

    Labels are compared by ``source_label``; target rows with one label are one source (smallest spelling, summed shares,
    smallest limit), those without a label are left out; null shares and limits are 0. Documents without a source, or of a
    source outside the mix, count in the total only. A source is ``limited`` where its exponent stops before 1; the tokens
    of ``max_repeats`` uses are then compared with the target once more in whole numbers, which settles rounding.
    """
    sources, total = _sources(documents, targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, share, repeats, docs, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                t, weight = source_weight(tokens / total if total else 0.0, share, repeats)
                limited = t < 1 and repeats * tokens < share * total
                t, weight = (t, weight) if limited else (1.0, share)
                rows.append((source, share, repeats, docs, tokens, t, weight, repeats * tokens if limited else math.floor(weight * total), limited))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PLAN_ARROW)], schema=_PLAN_ARROW)

    return Mix(materialize(sources.select("source", "share", "repeats", "docs", "tokens").mapInArrow(run, PLAN)), total)


def balanced_plan(documents: DataFrame, targets: DataFrame) -> Mix:
    """As ``mix_plan``, but every source gets its target share of the selection: all exponents are 1, and the selection is
    as large as the repetition limit of the scarcest source allows. Sources without tokens are left out of it."""
    sources, total = _sources(documents, targets)
    sources = materialize(sources)
    usable = F.expr("tokens > 0 and share > 0 and repeats > 0")
    shares, size = sources.where(usable).agg(F.sum("share"), F.min(F.col("repeats") * F.col("tokens") / F.col("share"))).first()
    weight = F.when(usable, F.col("share") / F.lit(float(shares or 1.0))).otherwise(F.lit(0.0))
    budget = F.floor(weight * F.lit(float(shares or 0.0) * float(size or 0.0)))
    plan = sources.select(
        "source", F.col("share").alias("target_share"), F.col("repeats").alias("max_repeats"), "docs", "tokens", F.lit(1.0).alias("exponent"), weight.alias("weight"),
        F.least(budget, F.col("repeats") * F.col("tokens")).cast("long").alias("budget"), (~usable & (F.col("share") > 0)).alias("limited"),
    )
    return Mix(materialize(plan.select(*_NAMES)), total)


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def _solve(df: DataFrame, value: Callable[[float], list[Column]], above: Callable[[tuple], bool], low: float, high: float, rounds: int = 9) -> float:
    """The largest number in [low, high] for which ``above`` holds of the aggregates ``value``; it holds up to some number.

    A bisection that tries WIDTH candidates in each pass over ``df``, so sources may be too many for the driver.
    """
    for _ in range(rounds):
        tried = [low + (high - low) * i / (WIDTH - 1) for i in range(WIDTH)]
        columns = [value(x) for x in tried]
        got = df.agg(*[c for cs in columns for c in cs]).first()
        n = len(columns[0])
        good = [i for i in range(WIDTH) if above(tuple(got[i * n : (i + 1) * n]))]
        last = good[-1] if good else 0
        low, high = tried[last], tried[min(last + 1, WIDTH - 1)]
    return low


def temperature_plan(documents: DataFrame, targets: DataFrame, goal: float | None = None, steepest: float = 8.0) -> Mix:
    """One exponent for all sources: weights are powers of the natural token shares, normalised.

    The exponent in [0, steepest] is bisected until the weights have the entropy ``goal``, by default that of the target
    shares of those sources that have tokens; 1 is the natural mix, 0 an even one, which has the largest entropy there is.
    (Exponents below 0 have the same entropies as some above, but favour the scarce sources, which cannot be repeated
    often.) Sources at their repetition limit stop there, and the rest of the tokens is filled into the others in proportion
    to their weights, as far as their limits allow.
    """
    sources, total = _sources(documents, targets)
    sources = materialize(sources.withColumn("p", F.col("tokens") / F.lit(float(total or 1))))
    live = materialize(sources.where("tokens > 0").withColumn("l", F.log("p")))
    if goal is None:
        s, m = live.where("share > 0").agg(F.sum("share"), F.sum(F.col("share") * F.log("share"))).first()
        goal = math.log(s) - m / s if s else 0.0

    def moments(a: float) -> list[Column]:
        raw = F.exp(F.lit(a) * F.col("l"))
        return [F.sum(raw), F.sum(raw * F.col("l") * F.lit(a))]

    flat = lambda got: got[0] and math.log(got[0]) - got[1] / got[0] >= goal
    exponent = _solve(live, moments, flat, 0.0, steepest)
    raw = F.exp(F.lit(exponent) * F.col("l"))
    mass = live.agg(F.sum(raw)).first()[0] or 1.0
    live = live.withColumn("w", raw / F.lit(mass)).withColumn("most", F.col("repeats") * F.col("p"))
    # The level up to which all are filled: the largest at which the mix does not exceed the whole.
    room = live.agg(F.sum("most")).first()[0] or 0.0
    level = 1.0
    if room <= 1.0:
        level = math.inf
    else:
        highest = live.where("w > 0").agg(F.max(F.col("most") / F.col("w"))).first()[0]
        level = _solve(live, lambda x: [F.sum(F.least("most", F.col("w") * F.lit(x)))], lambda got: got[0] <= 1.0, 0.0, float(highest), 14)
    weight = F.col("most") if math.isinf(level) else F.least(F.col("most"), F.col("w") * F.lit(level))
    plan = sources.join(live.select("source", weight.alias("weight"), "most"), "source", "left").select(
        "source", F.col("share").alias("target_share"), F.col("repeats").alias("max_repeats"), "docs", "tokens", F.lit(exponent).alias("exponent"), F.coalesce("weight", F.lit(0.0)).alias("weight"),
        F.when(F.col("weight") >= F.col("most"), F.col("repeats") * F.col("tokens")).otherwise(F.floor(F.coalesce("weight", F.lit(0.0)) * F.lit(float(total)))).cast("long").alias("budget"),
        (F.col("weight").isNull() | (F.col("weight") >= F.col("most"))).alias("limited"),
    )
    return Mix(materialize(plan), total)


_TAKEN = "source string, pass int, block bigint, doc_id bigint, n_tokens bigint"
_TAKEN_ARROW = pa.schema([("source", pa.string()), ("pass", pa.int32()), ("block", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64())])


def _fill(table: pa.Table) -> pa.Table:
    """Documents of the block where the budget ends, in permuted order, each taken if it still fits."""
    table = table.sort_by([("key", "ascending"), ("doc_id", "ascending")])
    left, keep = table.column("left")[0].as_py() if table.num_rows else 0, []
    for i, n in enumerate(table.column("n_tokens").to_pylist()):
        if n <= left:
            keep.append(i)
            left -= n
    return table.take(pa.array(keep, pa.int64())).select(_TAKEN_ARROW.names).cast(_TAKEN_ARROW)


def select_mix(documents: DataFrame, mix: Mix, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(source, pass, block, doc_id, n_tokens): the documents of every pass of every source, as its budget allows.

    ``documents`` is the table that ``mix`` was planned on, materialised. A document occurs at most once in a pass, so at
    most ``max_repeats`` times. ``block`` is the beginning of the key by which the pass is permuted. What is filled one by
    one is a block of at most ``block_docs`` documents (more only if that many rows have one doc_id).
    """
    plans = mix.plan.where("docs > 0 and tokens > 0 and budget > 0").select(
        source_label(F.col("source")).alias("label"), "source", "docs", F.expr("budget div tokens").alias("whole"), F.expr("budget % tokens").alias("rest")
    )
    plans = materialize(plans)
    most = plans.agg(F.max("docs")).first()[0] or 0
    own = lookup(documents.select("doc_id", "n_tokens", source_label(F.col("source")).alias("label")).where("label is not null"), plans, ["label"]).drop("docs")
    passes = own.select("source", "whole", "rest", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))).alias("pass"))
    keyed = passes.withColumn("key", F.xxhash64("doc_id", "pass"))
    begins = lambda bits: F.shiftright("key", 64 - bits) if bits else F.lit(0).cast("long")
    bits = min(BLOCK_BITS, max(0, math.ceil(most / block_docs) - 1).bit_length())
    whole = keyed.where(F.col("pass") < F.col("whole")).withColumn("block", begins(bits))
    last = materialize(keyed.where((F.col("pass") == F.col("whole")) & (F.col("rest") > 0)).select("source", "pass", "rest", "doc_id", "n_tokens", "key"))
    # The block in which the budget ends, by the first bits of the key, then by more of them.
    ends: DataFrame | None = None
    inside = last.select("source", "n_tokens", "key", F.col("rest").alias("left"))
    while True:
        sums = inside.groupBy("source", begins(bits).alias("block")).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"), F.max("left").alias("left"))
        upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
        end = sums.withColumn("upto", upto).where((F.col("upto") - F.col("tokens") < F.col("left")) & (F.col("upto") >= F.col("left")))
        ends = materialize(end.select("source", F.col("block").alias("end"), (F.col("left") - F.col("upto") + F.col("tokens")).alias("left"), "docs"))
        if bits + BLOCK_BITS > 64 or (ends.agg(F.max("docs")).first()[0] or 0) <= block_docs:
            break
        inside = lookup(last.select("source", "n_tokens", "key"), ends.select("source", "end", "left"), ["source"]).where(begins(bits) == F.col("end")).drop("end")
        bits += BLOCK_BITS
    cut = lookup(last.withColumn("block", begins(bits)), ends.select("source", "end", "left"), ["source"])
    rows = lambda df, *more: df.select("source", F.col("pass").cast("int").alias("pass"), "block", "doc_id", "n_tokens", *more)
    filled = rows(cut.where("block = end"), "key", "left").groupBy("source", "block").applyInArrow(_fill, _TAKEN)
    return rows(whole).unionByName(rows(cut.where("block < end"))).unionByName(filled)


def mix_report(mix: Mix, selection: DataFrame) -> DataFrame:
    """The plan of each source with what the selection really holds: tokens, share of all tokens, share of the selection."""
    got = materialize(selection.groupBy("source").agg(F.sum("n_tokens").alias("taken")))
    every = got.agg(F.sum("taken")).first()[0] or 0
    part = lambda whole: F.when(F.lit(whole) > 0, F.col("taken") / F.lit(whole)).otherwise(F.lit(0.0))
    return (
        mix.plan.join(got, "source", "left")
        .withColumn("taken", F.coalesce("taken", F.lit(0)))
        .withColumn("share_of_all", part(mix.total))
        .withColumn("share_of_selection", part(every))
    )
