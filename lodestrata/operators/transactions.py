"""Staged changes over a set of frames: begin, read own writes, commit or roll back."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from lodestrata.operators.mutations import commit_batch
from lodestrata.runtime import materialize


class Snapshot:
    """Named frames with a version; a commit makes the next one."""

    def __init__(self, frames: Mapping[str, DataFrame], version: int = 0, key: str = "id"):
        self.frames, self.version, self.key = dict(frames), version, key

    def begin(self) -> Transaction:
        return Transaction(self)


class Transaction:
    """Changes that nobody else sees until they are committed."""

    def __init__(self, base: Snapshot):
        self.base, self.open = base, True
        self._upserts: dict[str, list[DataFrame]] = {}
        self._deletes: dict[str, list[DataFrame]] = {}

    def _check(self) -> None:
        if not self.open:
            raise RuntimeError("the transaction has ended")

    def upsert(self, name: str, rows: DataFrame) -> None:
        self._check()
        self._upserts.setdefault(name, []).append(rows)

    def delete(self, name: str, keys: DataFrame) -> None:
        self._check()
        self._deletes.setdefault(name, []).append(keys)

    def read(self, name: str) -> DataFrame:
        """The frame with this transaction's changes."""
        self._check()
        out = self.base.frames[name]
        key = self.base.key
        nothing = out.select(key).where("false")
        ups = self._upserts.get(name, [])
        gone = nothing
        for part in self._deletes.get(name, []):
            gone = gone.unionByName(part.select(key))
        if not ups:
            return out.join(gone.distinct(), key, "left_anti")
        rows = ups[0]
        for later in ups[1:]:  # later rows replace earlier ones
            rows = rows.join(later.select(key), key, "left_anti").unionByName(later)
        return commit_batch(out, rows, gone.distinct(), key)

    def commit(self, current: Snapshot) -> Snapshot:
        """The next snapshot; refused if another commit came first."""
        self._check()
        if current.version != self.base.version:
            raise RuntimeError("the snapshot has moved on")
        names = self._upserts.keys() | self._deletes.keys()
        changed = {n: materialize(self.read(n), f"commit-{n}") for n in sorted(names)}
        self.open = False
        return Snapshot(current.frames | changed, current.version + 1, current.key)

    def rollback(self) -> None:
        self._check()
        self.open = False
