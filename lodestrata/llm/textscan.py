"""Vectorised word and shingle scanning over Arrow text columns.

All functions work on the UTF-8 buffer of a whole slice of rows with numpy, so
no Python code runs per character or per word.  A word class is given by the
set of ASCII bytes that separate words; every byte of a non-ASCII character
belongs to a word.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Bytes of text that are scanned together; a single longer text is one slice.
SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordClass:
    """Byte tables of one definition of a word; A-Z count as a-z in hashes."""

    def __init__(self, separators: bytes):
        self.is_word = np.ones(256, dtype=bool)
        self.is_word[list(separators)] = False
        folded = np.arange(256, dtype=np.uint64)
        folded[65:91] += np.uint64(32)
        self.value = mix((folded + np.uint64(1)) * np.uint64(_BASE))


#: Words are runs without ASCII white space.
SPACED = WordClass(bytes([0x20, *range(0x09, 0x0E)]))
#: Words are runs of digits, ASCII letters and non-ASCII characters.
ALNUM = WordClass(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))

_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


class Words:
    """Words of a slice of rows: byte spans, row numbers and 64-bit hashes."""

    def __init__(self, buf, offsets, starts, ends, rows, hashes):
        self.buf, self.offsets = buf, offsets
        self.starts, self.ends, self.rows, self.hashes = starts, ends, rows, hashes
        self.n_rows = len(offsets) - 1

    def bounds(self) -> np.ndarray:
        """First word number of every row, and the number of words at the end."""
        return np.searchsorted(self.rows, np.arange(self.n_rows + 1))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and row offsets of a string column; nulls are empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    raw = column.buffers()
    if len(column) == 0 or raw[1] is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Cut a batch into runs of rows whose texts hold about ``limit`` bytes."""
    if batch.num_rows == 0:
        return
    _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def scan(column: pa.Array, words: WordClass, chunk: int = 1 << 21) -> Words:
    """Find and hash all words of a string column; beyond ``chunk`` bytes in pieces cut between words, so that less is held at once."""
    buf, offsets = utf8(column)
    n = len(buf)
    found = []
    at = 0
    while at < n:
        to = _between_words(buf, min(at + chunk, n), words)
        edges = offsets[np.searchsorted(offsets, at, side="right") : np.searchsorted(offsets, to)] - at
        starts, ends, hashes = _scan_piece(buf[at:to], edges, words)
        found.append((starts + at, ends + at, hashes))
        at = to
    if not found:
        empty = np.empty(0, np.int64)
        return Words(buf, offsets, empty, empty, empty, np.empty(0, np.uint64))
    starts, ends, hashes = found[0] if len(found) == 1 else (np.concatenate(part) for part in zip(*found, strict=True))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return Words(buf, offsets, starts, ends, rows, hashes)


def pieces(column: pa.Array, words: WordClass, limit: int):
    """One text as string columns of one row of about ``limit`` bytes, cut between words."""
    buf, _ = utf8(column)
    at = 0
    while at < len(buf) or at == 0:
        to = _between_words(buf, min(at + limit, len(buf)), words)
        yield pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, to - at], np.int64)), pa.py_buffer(buf[at:to].tobytes()))
        if to == len(buf):
            return
        at = to


def _between_words(buf: np.ndarray, to: int, words: WordClass) -> int:
    """The first place from ``to`` on that lies in no word."""
    while 0 < to < len(buf) and words.is_word[buf[to - 1]] and words.is_word[buf[to]]:
        window = np.flatnonzero(~words.is_word[buf[to : to + (1 << 16)]])
        to = min(to + (int(window[0]) if len(window) else 1 << 16), len(buf))
    return to


def _scan_piece(buf: np.ndarray, edges: np.ndarray, words: WordClass) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(buf)
    inside = words.is_word[buf]
    begin = np.empty(n + 1, dtype=bool)
    begin[0], begin[n] = inside[0], False
    np.greater(inside[1:], inside[:-1], out=begin[1:n])
    end = np.empty(n + 1, dtype=bool)
    end[0], end[n] = False, inside[-1]
    np.less(inside[1:], inside[:-1], out=end[1:n])
    edges = edges[(edges > 0) & (edges < n)]
    begin[edges] = inside[edges]
    end[edges] = inside[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end)
    up, down = _power_tables(n + 1)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(words.value[buf] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return starts, ends, hashes


def run_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, hashes) of all runs of ``n`` consecutive words inside one row.

    A row of fewer words, but not none, has its whole sequence as one run.
    """
    total = len(words.hashes)
    first = words.bounds()
    counts = np.diff(first)
    rows, out = [], []
    if total >= n:
        h = np.zeros(total - n + 1, dtype=np.uint64)
        for k in range(n):
            h = mix(h * np.uint64(_BASE) + words.hashes[k : total - n + 1 + k] + np.uint64(k))
        own = words.rows[: total - n + 1]
        whole = own == words.rows[n - 1 :]
        rows.append(own[whole])
        out.append(h[whole])
    short = np.flatnonzero((counts > 0) & (counts < n))
    for row in short:
        h = np.uint64(0x5851F42D4C957F2D)
        with np.errstate(over="ignore"):
            for word in words.hashes[first[row] : first[row + 1]]:
                h = mix(np.array([h * np.uint64(_BASE) + word], dtype=np.uint64))[0]
        rows.append(np.array([row]))
        out.append(np.array([h], dtype=np.uint64))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    rows, out = np.concatenate(rows), np.concatenate(out)
    if len(short):
        order = np.argsort(rows, kind="stable")
        rows, out = rows[order], out[order]
    return rows, out


def schema_with(df: DataFrame, keep: list[str], added: str) -> StructType:
    """The schema of the kept columns and of added ones, given as DDL."""
    return StructType([*df.select(*keep).schema.fields, *StructType.fromDDL(added).fields])


#: Per-process caches by name; a task of another operator drops them.
CACHES: dict[str, dict] = {}


def released(run, cache: str = ""):
    """``run`` for mapInArrow, mindful of what idle workers hold.

    Workers stay alive between tasks, so what they keep counts against the
    executor: caches of other operators are dropped when a task begins, and
    freed memory goes back to the system at both ends.
    """

    def trim() -> None:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except OSError:  # another C library
            pass

    def whole(batches):
        others = [held for name, held in CACHES.items() if name != cache and held]
        for held in others:
            held.clear()
        if others:
            gc.collect()
            trim()
        yield from run(batches)
        trim()

    return whole
