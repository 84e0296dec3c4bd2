"""Session helpers shared by every operator: table access, durable lineage cuts, skew-safe joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one key that a task takes without being split, and rows that a broadcast may have.
ROWS_PER_SALT, MAX_BROADCAST = 100_000, 500_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One Parquet table of a data directory, cut to ``columns`` when given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that ``checkpoint()`` writes to.

    A cluster names its shared folder in ``spark.checkpoint.dir``; only a local session without one (tests, a laptop)
    gets a temporary folder, which is removed at exit. A cluster that names none is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="edgeweave-checkpoint-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint, which outlives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` with the number of each row within its ``keys``, from 1, by ``order``; any key may hold any share of the rows.

    Rows are sorted into ranges of about equal size, numbered inside each, and the ranges before are added up per key.
    """
    keys, order = list(keys), list(order)
    parts = materialize(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = parts.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order)))
    sizes = sizes.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__part").alias("__p"), before.alias("__before"))
    on = F.col("__part") == F.col("__p")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return inside.join(sizes, on).select(*df.columns, (F.col("__r") + F.col("__before")).alias(name))


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage: what finished plans, their generated code and their checkpoints leave behind.

    Operators that run dozens of small jobs call this now and then; without it the driver keeps all of it until its heap is
    full, and the files of dropped checkpoints with it.
    """
    spark._jvm.System.gc()


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_salt: int = ROWS_PER_SALT) -> DataFrame | None:
    """(__hash, __salts) of the keys that hold more than ``rows_per_salt`` rows of ``df``; None if there are none.

    The list stays distributed and names keys by their hash, 12 bytes each. Up to 5 * 10^10 rows it has at most MAX_BROADCAST
    entries, as each stands for ``rows_per_salt`` rows; beyond, keys count as hot from rows / MAX_BROADCAST on, which is
    still far below what a partition of such a table holds. So it can always be broadcast.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows_per_salt)
    hot = materialize(counts.select(F.xxhash64(*keys).alias("__hash"), "__n"))
    found = hot.agg(F.count(F.lit(1)), F.sum("__n")).first()
    if not found[0]:
        return None
    if found[0] > MAX_BROADCAST:
        hot = hot.where(F.col("__n") > df.count() / MAX_BROADCAST)
    return hot.groupBy("__hash").agg(F.ceil(F.sum("__n") / rows_per_salt).cast("int").alias("__salts"))


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", rows_per_salt: int = ROWS_PER_SALT, nulls: bool = False, hot: DataFrame | bool | None = True
) -> DataFrame:
    """Equi-join whose left side may have keys that hold a large part of all rows.

    Keys with more than ``rows_per_salt`` rows on the left are spread over ``ceil(rows / rows_per_salt)`` salts; only
    the right rows of those keys are repeated, once per salt. Without such keys this is a plain join. ``how`` is
    ``inner`` or ``left``. Null keys match nothing, or with ``nulls`` each other; a left join keeps their rows. Result
    columns: the keys once, then the other columns of both sides. The left side is read twice (once to count its keys),
    so pass it materialised; ``hot`` saves that where a list
    like that of ``hot_keys``, or that there is none, is known already.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left joins")
    keys = list(keys)
    if not nulls and how == "inner":
        for k in keys:
            left = left.where(F.col(k).isNotNull())
    own = [c for c in left.columns if c not in keys]
    other = [c for c in right.columns if c not in keys]
    hot = hot_keys(left, keys, rows_per_salt) if hot is True else hot
    if hot is not None:
        few = F.coalesce("__salts", F.lit(1))
        salt = F.pmod(F.xxhash64(*left.columns), few).cast("int")
        left = left.withColumn("__hash", F.xxhash64(*keys)).join(F.broadcast(hot), "__hash", "left").withColumn("__salt", salt).drop("__hash", "__salts")
        right = right.withColumn("__hash", F.xxhash64(*keys)).join(F.broadcast(hot), "__hash", "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), few - 1))).drop("__hash", "__salts")
    salted = ["__salt"] if hot is not None else []
    if not nulls:
        return left.join(right, [*keys, *salted], how).select(*keys, *own, *other)
    right = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"__right_{k}"])
    for k in salted:
        on = on & (left[k] == right[k])
    return left.join(right, on, how).select(*[left[k] for k in keys], *own, *other)


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", most: int = MAX_BROADCAST) -> DataFrame:
    """Columns of ``right``, which has one row per key, for the rows of ``left``; null keys match each other.

    ``right`` is counted: up to ``most`` rows it is broadcast, beyond that the join is salted. Pass both materialised.
    """
    keys = list(keys)
    if right.limit(most + 1).count() > most:
        return salted_join(left, right, keys, how, nulls=True)
    own, other = [c for c in left.columns if c not in keys], [c for c in right.columns if c not in keys]
    right = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"__right_{k}"])
    return left.join(F.broadcast(right), on, how).select(*[left[k] for k in keys], *own, *other)
