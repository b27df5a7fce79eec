"""A sharded dataset with size-tiered compaction and an atomically committed manifest.

Arrivals are appended as small immutable Parquet shards.  Compaction merges
runs of shards of similar size, each into one file of the target size.  Each
change writes its files first and then commits a new manifest version: a
finished file is given a name that must not exist yet, so of two writers one
wins and the other builds on its version; readers see one version or the next.
A version holds what it adds and removes, and every few versions the whole.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lodestrata.runtime import delete_path


@dataclass(frozen=True)
class ShardParams:
    """``target``: bytes of a full shard; ``arrival``: of a shard of an append; ``fanout``: shards of a tier that are merged.

    ``whole_every``: versions between two that list all shards.
    """

    target: int = 128 << 20
    arrival: int = 8 << 20
    fanout: int = 4
    whole_every: int = 16


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int


class CommitConflict(RuntimeError):
    """Another writer has committed the same version."""


class ShardStore:
    """Shards below ``path``: data/<change>/..., and manifests/v<number>.json.

    Rows of any kind are kept as they are, nulls, repeats and very long texts
    among them.  Several writers may work at once: appends always succeed in
    some order; a compaction whose inputs another one has merged raises
    CommitConflict and leaves the dataset as it is.
    """

    def __init__(self, spark: SparkSession, path: str, params: ShardParams = ShardParams()):
        self.spark, self.path, self.params = spark, path.rstrip("/"), params
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _entry(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/manifests/v{version:08d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> tuple[int, dict]:
        """(version, {"schema", "shards"}); version 0 is empty."""
        if version is None:
            version = max(self.versions(), default=0)
        changes = []
        for number in range(version, 0, -1):
            changes.append(self._entry(number))
            if changes[-1]["whole"]:
                break
        schema, shards = None, {}
        for change in reversed(changes):
            schema = change["schema"]
            for path in change["removed"]:
                del shards[path]
            shards.update((s["path"], s) for s in change["added"])
        return version, {"schema": schema, "shards": list(shards.values())}

    def commit(self, base: int, change: dict) -> int:
        """Publish a change as version ``base + 1``, or raise if that is there already."""
        folder = self._path(f"{self.path}/manifests")
        self._fs.mkdirs(folder)
        final = self._path(folder, f"v{base + 1:08d}.json")
        draft = self._path(folder, f".draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(change).encode()))
        stream.close()
        if self._fs.exists(final) or not self._publish(draft, final):
            self._fs.delete(draft, False)
            raise CommitConflict(f"version {base + 1} exists")
        return base + 1

    def _publish(self, draft, final) -> bool:
        """Give the draft its final name, if no file has that name."""
        if self._fs.getUri().getScheme() != "file":
            return self._fs.rename(draft, final)  # Hadoop's rename replaces no file
        # On local disks a rename replaces; a second link to the file does not.
        files, paths = self._jvm.java.nio.file.Files, self._jvm.java.nio.file.Paths
        try:
            files.createLink(*(paths.get(self._fs.makeQualified(path).toUri()) for path in (final, draft)))
        except Exception:
            if self._fs.exists(final):
                return False
            raise
        self._fs.delete(draft, False)
        return True

    def _change(self, schema: str, added: list[Shard], removed: list[str]) -> int:
        """Commit on top of the newest version, again after each version of another writer."""
        while True:
            base, manifest = self.manifest()
            here = {s["path"] for s in manifest["shards"]}
            if not here.issuperset(removed):
                raise CommitConflict("another writer has merged these shards")
            new = [asdict(s) for s in added]
            change = {"whole": False, "schema": manifest["schema"] or schema, "added": new, "removed": removed}
            if (base + 1) % self.params.whole_every == 0:
                gone = set(removed)
                change |= {"whole": True, "added": [s for s in manifest["shards"] if s["path"] not in gone] + new, "removed": []}
            try:
                return self.commit(base, change)
            except CommitConflict:
                continue

    def _written(self, folder: str, write: Callable[[str], None]) -> list[Shard]:
        """Run a write into ``folder`` and list its shards; a change's file names are unique."""
        write(folder)
        found = {}
        files = self._fs.listFiles(self._path(folder), True)
        while files.hasNext():
            status = files.next()
            if status.getPath().getName().endswith(".parquet"):
                found[status.getPath().getName()] = (status.getPath().toString(), status.getLen())
        if not found:
            return []
        named = self.spark.read.parquet(folder)
        rows = {r["f"]: r["count"] for r in named.select(named.metadataColumn("_metadata")["file_name"].alias("f")).groupBy("f").count().collect()}
        if not rows.keys() <= found.keys():
            raise RuntimeError(f"files of {folder} are not those that were listed")
        return sorted((Shard(path, size, rows.get(name, 0)) for name, (path, size) in found.items()), key=lambda s: s.path)

    def append(self, df: DataFrame, size_hint: int | None = None) -> int:
        """Write an arrival as small shards and commit; an empty arrival commits no shard.

        ``size_hint``: its bytes as Parquet; without one, each of its partitions makes one shard.
        """
        folder = f"{self.path}/data/append-{uuid.uuid4().hex}"
        if size_hint is not None:  # fewer tasks write fewer shards; nothing is shuffled
            df = df.coalesce(max(1, math.ceil(size_hint / self.params.arrival)))
        shards = self._written(folder, lambda path: df.write.parquet(path))
        return self._change(df.schema.json(), [s for s in shards if s.rows], [])

    def tier(self, size: int) -> int:
        return max(0, int(math.log(max(size, 1) / (self.params.arrival / self.params.fanout), self.params.fanout)))

    def plan(self, shards: list[Shard], everything: bool = False) -> list[list[list[Shard]]]:
        """By tier, groups to merge: of tiers with enough shards, runs in order of size that fill a target-sized file.

        ``everything`` also merges tiers of too few shards, as a final pass does.
        """
        tiers: dict[int, list[Shard]] = {}
        for shard in shards:
            if shard.bytes < self.params.target * 0.75:
                tiers.setdefault(0 if everything else self.tier(shard.bytes), []).append(shard)
        out = []
        for _, members in sorted(tiers.items()):
            if len(members) < (2 if everything else self.params.fanout):
                continue
            members.sort(key=lambda s: (-s.bytes, s.path))
            while True:  # shards that would be alone stay as they are
                groups: list[list[Shard]] = []
                filled = 0
                for shard in members:
                    if not groups or filled + shard.bytes > self.params.target:
                        groups.append([])
                        filled = 0
                    groups[-1].append(shard)
                    filled += shard.bytes
                if all(len(g) > 1 for g in groups):
                    break
                members = [s for g in groups if len(g) > 1 for s in g]
            if groups:
                out.append(groups)
        return out

    def compact(self, everything: bool = False) -> int:
        """Merge each planned group into one file, a job for each tier; returns the version then current."""
        base, manifest = self.manifest()
        tiers = self.plan([Shard(**s) for s in manifest["shards"]], everything)
        if not tiers:
            return base
        # A scan takes files in order of size and closes a partition that the next would bring beyond the
        # limit, as the plan does, so each group is one task and one file, and nothing is shuffled.
        packing = {
            "spark.sql.files.maxPartitionBytes": str(self.params.target),
            "spark.sql.files.openCostInBytes": "0",
            "spark.sql.files.minPartitionNum": "1",
        }
        before = {key: self.spark.conf.get(key, None) for key in packing}
        made: list[Shard] = []
        try:
            for key, value in packing.items():
                self.spark.conf.set(key, value)
            for groups in tiers:
                merged = self._read([s for group in groups for s in group], manifest["schema"])
                made += self._written(f"{self.path}/data/merge-{uuid.uuid4().hex}", lambda path, merged=merged: merged.write.parquet(path))
        finally:
            for key, value in before.items():
                self.spark.conf.set(key, value) if value is not None else self.spark.conf.unset(key)
        gone = [s for groups in tiers for group in groups for s in group]
        if sum(s.rows for s in made) != sum(s.rows for s in gone):
            raise RuntimeError("a merge changed the number of rows")
        return self._change(manifest["schema"], made, [s.path for s in gone])

    def _read(self, shards: list[Shard], schema: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*[s.path for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        _, manifest = self.manifest(version)
        if manifest["schema"] is None:
            raise ValueError("nothing has been appended")
        if not manifest["shards"]:
            return self.spark.createDataFrame([], StructType.fromJson(json.loads(manifest["schema"])))
        return self._read([Shard(**s) for s in manifest["shards"]], manifest["schema"])

    def vacuum(self, older_than: float = 86400.0) -> int:
        """Delete files that the current version does not name; returns their number.

        Files younger than ``older_than`` seconds stay, as a change that is
        under way, or a reader of an older version, may need them.
        """
        latest = (time.time() - older_than) * 1000
        folder = self._path(f"{self.path}/data")
        found = []
        if self._fs.exists(folder):
            files = self._fs.listFiles(folder, True)
            while files.hasNext():
                status = files.next()
                if status.getPath().getName().endswith(".parquet") and status.getModificationTime() <= latest:
                    found.append(status.getPath().toString())
        named = {s["path"] for s in self.manifest()[1]["shards"]}  # read last: what was committed meanwhile is named
        gone = [path for path in found if path not in named]
        for path in gone:
            delete_path(self.spark, path)
        return len(gone)
