"""Hash filters of bounded size that go to every executor."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.joins import skew_join

__all__ = ["HashFilter", "skew_join"]


class HashFilter:
    """A Bloom filter of 64-bit hashes: two bits each, at most 2 ** ``max_bits`` bits whatever the data."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.shift = 64 - (len(table) * 64).bit_length() + 1

    def __contains__(self, one: int) -> bool:
        return bool(self.has(np.array([one], dtype=np.uint64))[0])

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes may be in the set; those that are, are."""
        low = hashes & np.uint64(len(self.table) * 64 - 1)
        found = (self.table[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1)
        at = np.flatnonzero(found)
        high = hashes[at] >> np.uint64(self.shift)
        sure = (self.table[(high >> np.uint64(6)).astype(np.int64)] >> (high & np.uint64(63))) & np.uint64(1)
        out = np.zeros(len(hashes), dtype=bool)
        out[at[sure.astype(bool)]] = True
        return out

    @classmethod
    def of(cls, hashes: DataFrame, column: str, max_bits: int = 26) -> HashFilter:
        """The filter of a column of well mixed 64-bit hashes; the driver gets its words, never the hashes."""
        n = hashes.count()
        bits = min(max_bits, max(12, int(max(n, 1) * 24).bit_length()))
        h = F.col(column)
        places = F.array(h.bitwiseAND(F.lit((1 << bits) - 1)), F.shiftrightunsigned(h, 64 - bits))
        at = hashes.select(F.explode(places).alias("at")).select(F.shiftright("at", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(at & 63 AS INT))").alias("bit"))
        found = at.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        table = np.zeros(1 << (bits - 6), dtype=np.uint64)
        if found.num_rows:
            table[np.asarray(found.column("word"))] = np.asarray(found.column("bits")).view(np.uint64)
        return cls(table)
