"""Published snapshots: immutable Parquet folders named by content, with a manifest, leases and pins.

A snapshot is written beside its place and renamed into it, so readers see all of it or nothing. The current one of a
logical name is a small pointer file, replaced in one step.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..derive import content_hash
from ..facts import FactSnapshot, Relation
from .storage import Storage

FORMAT = 1


class ArtifactError(RuntimeError):
    pass


class ArtifactStore:
    """``root`` is a folder of a file system that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Storage(spark, root)
        for d in ("objects", "current", "holds"):
            self.files.make(d)

    def publish(self, name: str, tables: dict[str, DataFrame], completeness: str = "complete", trust: str = "producer-verified") -> str:
        """Write the tables and make them the current snapshot of ``name``; equal content is stored once."""
        hashes = {t: content_hash(df) for t, df in sorted(tables.items())}
        digest = hashlib.sha256(json.dumps(hashes).encode()).hexdigest()
        if not self.files.exists(f"objects/{digest}"):
            beside = f"objects/.{uuid.uuid4().hex}"
            for t, df in tables.items():
                df.write.parquet(self.files.at(f"{beside}/{t}.parquet"))
            manifest = {"format": FORMAT, "content": {t: str(h) for t, h in hashes.items()}, "completeness": completeness, "trust": trust}
            self.files.write(f"{beside}/manifest.json", json.dumps(manifest, indent=2))
            if not self.files.move(beside, f"objects/{digest}"):  # another writer was first
                self.files.remove(beside)
        pointer = f"current/.{uuid.uuid4().hex}"
        self.files.write(pointer, digest)
        self.files.move(pointer, f"current/{name}", over=True)
        return digest

    def current(self, name: str) -> str | None:
        return self.files.read(f"current/{name}") if self.files.exists(f"current/{name}") else None

    def manifest(self, digest: str) -> dict:
        return json.loads(self.files.read(f"objects/{digest}/manifest.json"))

    def attach(self, name: str) -> FactSnapshot:
        digest = self.current(name)
        if digest is None:
            raise ArtifactError(f"no snapshot of '{name}'")
        manifest = self.manifest(digest)
        if manifest["format"] != FORMAT:
            raise ArtifactError("the snapshot has another format")
        relations = {t: Relation(self.spark.read.parquet(self.files.at(f"objects/{digest}/{t}.parquet")), manifest["completeness"], name) for t in manifest["content"]}
        return FactSnapshot(relations, digest)

    def validate(self, name: str) -> bool:
        """Whether the stored rows are those that were published."""
        snapshot = self.attach(name)
        return {t: str(h) for t, h in snapshot.content().items()} == self.manifest(snapshot.identity)["content"]

    def hold(self, digest: str, seconds: float | None = None) -> str:
        """Keep a snapshot from being removed: for a time (a lease) or until released (a pin)."""
        token = uuid.uuid4().hex
        self.files.write(f"holds/{token}", json.dumps({"digest": digest, "until": None if seconds is None else time.time() + seconds}))
        return token

    def release(self, token: str) -> None:
        self.files.remove(f"holds/{token}")

    def recover(self) -> list[str]:
        """Remove what an interrupted writer left, expired leases, and snapshots that nothing needs; gives their digests."""
        held = set()
        for token in self.files.names("holds"):
            if token.startswith("."):
                continue
            h = json.loads(self.files.read(f"holds/{token}"))
            if h["until"] is not None and h["until"] < time.time():
                self.release(token)
            else:
                held.add(h["digest"])
        held |= {self.files.read(f"current/{n}") for n in self.files.names("current") if not n.startswith(".")}
        gone = [d for d in self.files.names("objects") if d not in held]
        for d in gone:
            self.files.remove(f"objects/{d}")
        return gone


def freshness(recorded: str | None, present: str | None) -> str:
    """current, stale, or unverifiable where either identity is missing."""
    if recorded is None or present is None:
        return "unverifiable"
    return "current" if recorded == present else "stale"
