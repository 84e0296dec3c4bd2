"""Filling fixed-capacity windows with documents: sum-of-squares online packing.

A document goes to the fill level (an open window of that level, or a new one) that makes the sum over all levels of the
squared number of windows at that level smallest afterwards. The windows open at each level are kept in a level array.

Documents are packed in shards of a fixed size, each an independent stream with its own level array, so the work is spread
and no task's memory grows with the corpus. When a stream ends, the windows it left partly filled are merged where they
fit into each other, fullest first (best fit); ``stream_window`` is the window before that.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents in a shard; most partitions that the shards are spread over; containers that a plan lists by name, beyond which they are joined.
SHARD_DOCS, MAX_PARTITIONS, MAX_LISTED = 50_000, 20_000, 1000

PACKED = "container string, shard bigint, window int, doc_id bigint, piece int, pieces int, tokens bigint, start_in_window bigint, start_in_doc bigint, stream_window int"
_ARROW = pa.schema(
    [("container", pa.string()), ("shard", pa.int64()), ("window", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("pieces", pa.int32()), ("tokens", pa.int64()), ("start_in_window", pa.int64()), ("start_in_doc", pa.int64()), ("stream_window", pa.int32())]
)


class LevelPacker:
    """One online stream: ``place`` gives the window of an item of 1..capacity units."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)  # windows open at each fill level
        self.open: dict[int, list[int]] = {}  # the windows behind the counts
        self.fill: list[int] = []

    def place(self, size: int) -> int:
        # Moving a window from level h to t changes the sum of squares by (2 N[t] + 1) - (2 N[h] - 1); a new window
        # has no level before, a full one none after.
        counts, capacity = self.counts, self.capacity
        best, level = (0 if size == capacity else 2 * int(counts[size]) + 1), 0
        if size < capacity:
            at = np.flatnonzero(counts[1 : capacity - size + 1]) + 1
            if at.size:
                to = at + size
                cost = np.where(to == capacity, 0, 2 * counts[to] + 1) - (2 * counts[at] - 1)
                k = at.size - 1 - int(np.argmin(cost[::-1]))  # of equal ones, the fullest
                if cost[k] <= best:
                    level = int(at[k])
        if level:
            window = self.open[level].pop()
            counts[level] -= 1
        else:
            window = len(self.fill)
            self.fill.append(0)
        after = level + size
        self.fill[window] = after
        if after < capacity:
            counts[after] += 1
            self.open.setdefault(after, []).append(window)
        return window

    def merged(self) -> list[int]:
        """For each window the one it ends up in: partly filled windows are put into each other, fullest first, best fit."""
        target = list(range(len(self.fill)))
        room: list[tuple[int, int]] = []  # (room left, window), ascending
        for fill, w in sorted(((f, w) for w, f in enumerate(self.fill) if 0 < f < self.capacity), key=lambda x: (-x[0], x[1])):
            k = bisect.bisect_left(room, (fill, -1))
            into, left = w, self.capacity - fill
            if k < len(room):
                have, into = room.pop(k)
                target[w], left = into, have - fill
            if left:
                bisect.insort(room, (left, into))
        return target


def pack_shard(capacity: int, doc_ids: list[int], sizes: list[int]) -> list[tuple]:
    """(window, doc, piece, pieces, tokens, start in window, start in doc, window before merging) of one stream, documents in the given order."""
    packer = LevelPacker(capacity)
    placed = []
    for doc, size in zip(doc_ids, sizes):
        pieces = max(1, -(-size // capacity))
        for piece in range(pieces):
            tokens = min(capacity, size - piece * capacity)
            placed.append((packer.place(tokens) if tokens else 0, doc, piece, pieces, tokens, piece * capacity))
    target = packer.merged()
    number = {w: n for n, w in enumerate(sorted(set(target)))}
    filled: dict[int, int] = {}
    rows = []
    for window, doc, piece, pieces, tokens, start in placed:
        w = number[target[window]] if target else 0
        rows.append((w, doc, piece, pieces, tokens, filled.get(w, 0), start, window))
        filled[w] = filled.get(w, 0) + tokens
    return rows


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    container, capacity, shard = (k.as_py() for k in key)
    table = table.sort_by("doc_id")
    rows = pack_shard(capacity, table.column("doc_id").to_pylist(), table.column("n_tokens").to_pylist())
    columns = list(zip(*rows))
    same = [pa.array([container] * len(rows), pa.string()), pa.array([shard] * len(rows), pa.int64())]
    return pa.Table.from_arrays([*same, *[pa.array(c, f.type) for c, f in zip(columns, list(_ARROW)[2:])]], schema=_ARROW)


def pack(documents: DataFrame, containers: DataFrame, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The contents of the windows: every document (doc_id BIGINT, n_tokens BIGINT) in windows of every container.

    ``containers`` has container STRING and capacity BIGINT; rows without a positive capacity are left out. A document that
    fits is never split. One that exceeds the capacity fills whole windows and leaves a last piece, which is packed like any
    other; ``pieces`` counts them. A document without tokens (null counts as none) has a row of 0 tokens in window 0. Rows
    without a doc_id are left out; a doc_id that occurs twice is packed twice. Windows are numbered from 0 within
    (container, shard). No documents give no rows.
    """
    spec = containers.where("container is not null and capacity > 0").select("container", F.col("capacity").cast("long").alias("capacity")).distinct()
    docs = documents.where("doc_id is not null").select("doc_id", F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("long").alias("n_tokens"))
    shards = -(-docs.count() // shard_docs) or 1
    sharded = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    if len(listed := spec.limit(MAX_LISTED + 1).collect()) <= MAX_LISTED:
        if not listed:
            return documents.sparkSession.createDataFrame([], PACKED)
        each = F.array(*[F.struct(F.lit(n).alias("container"), F.lit(c).cast("long").alias("capacity")) for n, c in sorted(listed)])
        spread = sharded.withColumn("s", F.explode(each)).select("s.container", "s.capacity", "shard", "doc_id", "n_tokens")
    else:
        spread = sharded.join(spec.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))), "shard")
    # Streams take CPU, not bytes: without a number of its own the shuffle would be folded into a few tasks.
    keys, parts = ["container", "capacity", "shard"], min(4 * shards * len(listed), MAX_PARTITIONS)
    return spread.select(*keys, "doc_id", "n_tokens").repartition(parts, *keys).groupBy(*keys).applyInArrow(_pack, PACKED)
