"""Derived facts kept up to date in micro-batches: only the keys that a batch touches are computed anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..derive import affected
from ..sources.storage import Storage


class RollUp:
    """An aggregate per key over a growing table: each batch writes its own aggregates only, a delta; reading merges them.

    ``measures`` are aggregates that add up batch by batch, given with the SQL function that merges them (sum, min, max).
    After ``compact_after`` deltas they are written together as a base. A batch that is delivered again, after a failure,
    is recognised by its number and changes nothing. The last base but one is kept for readers that still use it.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], measures: dict[str, tuple[Column, str]], compact_after: int = 32):
        self.spark, self.path, self.keys, self.measures, self.compact_after = spark, path, keys, measures, compact_after
        self.files = Storage(spark, path)

    def _written(self, kind: str) -> list[int]:
        return sorted(int(n[1:]) for n in self.files.names("") if n[0] == kind and self.files.exists(f"{n}/_SUCCESS"))

    def _parts(self) -> tuple[int, list[str]]:
        """(number of the last base or -1, what is read: that base and the deltas after it)."""
        bases = self._written("b")
        base = bases[-1] if bases else -1
        return base, [f"b{base}"] * bool(bases) + [f"d{n}" for n in self._written("d") if n > base]

    def current(self) -> DataFrame | None:
        _, parts = self._parts()
        if not parts:
            return None
        every = self.spark.read.parquet(*[self.files.at(p) for p in parts])
        return every.groupBy(*self.keys).agg(*[F.expr(f"{f}(`{n}`)").alias(n) for n, (_, f) in self.measures.items()])

    def apply(self, batch: DataFrame, number: int) -> None:
        base, parts = self._parts()
        if number <= base or f"d{number}" in parts:
            return
        part = batch.groupBy(*self.keys).agg(*[c.alias(n) for n, (c, _) in self.measures.items()])
        part.write.mode("overwrite").parquet(self.files.at(f"d{number}"))
        if len(parts) >= self.compact_after:
            self.compact()

    def compact(self) -> None:
        base, parts = self._parts()
        if parts and (upto := int(parts[-1][1:])) > base:
            self.current().write.mode("overwrite").parquet(self.files.at(f"b{upto}"))
            for kind, n in [*(("b", n) for n in self._written("b")), *(("d", n) for n in self._written("d"))]:
                if (n < base) if kind == "b" else (n <= base):
                    self.files.remove(f"{kind}{n}")

    def start(self, stream: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str, lateness: str) -> DataFrame:
    """Counts per key and time window of a stream; rows later than ``lateness`` are left out once their window is closed."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, width).alias("window"), *keys).agg(F.count(F.lit(1)).alias("n"))


def first_claims(claims: DataFrame, key: str, rank: str) -> DataFrame:
    """The first claimant of each key by rank; ties go to the smallest row."""
    others = [c for c in claims.columns if c not in (key, rank)]
    return claims.groupBy(key).agg(F.min(F.struct(rank, *others)).alias("c")).select(key, *[F.col(f"c.{n}").alias(n) for n in (rank, *others)])


def incremental(old: DataFrame, rows: DataFrame, keys: list[str], touched: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A derived table after a change: computed anew from the rows of the touched keys only, other keys as they were."""
    part = rows.join(touched.select(*keys).distinct(), keys, "left_semi")
    return affected(old, build(part), keys, touched)
