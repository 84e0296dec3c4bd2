"""References to records that do not exist: as-of matching against runs of contiguous parent keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize, salted_join

#: Keys are matched in blocks of 2^BLOCK_BITS neighbouring ids; no task ever holds more ids than one block has.
BLOCK_BITS = 16


def key_runs(parents: DataFrame) -> DataFrame:
    """(parent, block, living, first, last, loaded): contiguous runs of the ids in ``parents``, cut at block borders.

    ``parents`` has a row per (parent, id) with ``living`` (any row not deleted) and ``loaded`` (its earliest load time).
    Runs are made twice: of all ids (living = false) and of the living ones (living = true); ``loaded`` is the latest of
    the run's earliest load times.
    """
    kinds = parents.select(
        "parent", "id", "loaded", F.explode(F.when(F.col("living"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("living")
    ).withColumn("block", F.shiftright("id", BLOCK_BITS))
    order = Window.partitionBy("parent", "block", "living").orderBy("id")
    return (
        kinds.withColumn("run", F.col("id") - F.row_number().over(order))
        .groupBy("parent", "block", "living", "run")
        .agg(F.min("id").alias("first"), F.max("id").alias("last"), F.max("loaded").alias("loaded"))
        .drop("run")
    )


def orphan_references(references: DataFrame, parents: DataFrame) -> DataFrame:
    """Every reference whose target is missing, deleted, or came later than the reference.

    ``references``: parent (which table it points into), table, column, key, target BIGINT, period, loaded. The same
    (parent, table, column, key, target, period) is one reference, loaded at the earliest of its rows; null targets refer
    to nothing. ``parents``: parent, id BIGINT, deleted BOOLEAN, loaded; null ids are none. Result: table, column, key,
    target, period, cause. ``missing``: the id has no row; ``deleted``: all its rows are deleted; ``late``: its earliest
    load is after the reference's (unknown where either load time is null, and then not reported).

    References are reduced to distinct targets before they are matched, so a popular target is one row; the way back to
    the references salts hot targets. Tables without rows are allowed on both sides.
    """
    refs = materialize(
        references.where("target is not null").groupBy("parent", "table", "column", "key", "target", "period").agg(F.min("loaded").alias("loaded"))
    )
    ids = materialize(
        parents.where("id is not null").groupBy("parent", "id").agg(F.max(~F.col("deleted")).alias("living"), F.min("loaded").alias("loaded"))
    )
    targets = refs.groupBy("parent", "target").agg(F.min("loaded").alias("seen"))
    runs = key_runs(ids)
    line = runs.select(
        "parent", "block", F.col("first").alias("at"), F.lit(0).alias("is_ref"), "living", F.struct("last", "loaded").alias("run"), F.lit(None).cast(refs.schema["loaded"].dataType).alias("seen")
    ).unionByName(
        targets.select(
            "parent", F.shiftright("target", BLOCK_BITS).alias("block"), F.col("target").alias("at"), F.lit(1).alias("is_ref"), F.lit(None).cast("boolean").alias("living"), F.lit(None).cast(
                f"struct<last:bigint,loaded:{ids.schema['loaded'].dataType.simpleString()}>").alias("run"), "seen"
        )
    )
    before = Window.partitionBy("parent", "block").orderBy("at", "is_ref").rowsBetween(Window.unboundedPreceding, 0)
    matched = line.select(
        "parent",
        F.col("at").alias("target"),
        "is_ref",
        "seen",
        F.last(F.when(~F.col("living"), F.col("run")), ignorenulls=True).over(before).alias("any_run"),
        F.last(F.when(F.col("living"), F.col("run")), ignorenulls=True).over(before).alias("living_run"),
    ).where("is_ref = 1")
    beyond = lambda run: F.col(run).isNull() | (F.col("target") > F.col(f"{run}.last"))
    judged = matched.select(
        "parent",
        "target",
        F.when(beyond("any_run"), "missing").when(beyond("living_run"), "deleted").when(F.col("any_run.loaded") > F.col("seen"), "late").alias("cause"),
    )
    judged = materialize(judged.where("cause is not null"))
    # A run only says that some id in it came late; its own load time decides.
    late = judged.where("cause = 'late'").join(ids.select("parent", F.col("id").alias("target"), F.col("loaded").alias("came")), ["parent", "target"])
    verdicts = judged.where("cause <> 'late'").withColumn("came", F.lit(None).cast(ids.schema["loaded"].dataType)).unionByName(late)
    found = salted_join(refs, verdicts, ["parent", "target"])
    return found.where("cause <> 'late' or came > loaded").select("table", "column", "key", "target", "period", "cause")
