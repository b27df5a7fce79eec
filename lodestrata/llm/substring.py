"""Substring deduplication by sliding spans of sentences.

From each sentence, forwards and backwards, the run of consecutive sentences
grows until it has enough words; these runs, and every sentence that is long
enough to be a passage by itself, are hashed.  Hashes are counted over all
documents first; only spans that occur more than once are then joined
globally.  The first occurrence (by doc_id, then place) stays, and sentences
that any other occurrence covers are removed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import textscan
from lodestrata.llm.joins import HashFilter, skew_join
from lodestrata.runtime import materialize, ship, small_batches

#: A sentence ends with .!? before white space, or with a line; white space after it belongs to it.
SENTENCE = re.compile(r"[\x09-\x0D\x20]*(?:[^.!?\n]|[.!?]+[^.!?\x09-\x0D\x20])*(?:[.!?]+[\x09-\x0D\x20]*|\n[\x09-\x0D\x20]*|$)")


@dataclass(frozen=True)
class SubstringParams:
    """``run``: least sentences of a span; ``min_words``: a span grows by sentences until it has so many words.

    Repeats of fewer words (set phrases, greetings) are no duplicates of a
    passage and stay.  ``long_words``: a sentence of this many words is a span
    by itself, as its neighbours may differ.
    """

    run: int = 2
    min_words: int = 12
    long_words: int = 25

    def __post_init__(self) -> None:
        if not (1 <= self.run <= 255 and 1 <= self.min_words <= 255):
            raise ValueError("run and min_words must be from 1 to 255, as a place holds a span's sentences in 8 bits")


def sentences(text: str) -> list[tuple[int, int]]:
    """Places of the non-empty sentences of a text, which together are the text."""
    return [m.span() for m in SENTENCE.finditer(text) if m.end() > m.start()]


class SentenceIndex:
    """Sentences of a slice of rows as runs of words, found on the bytes of the whole slice."""

    def __init__(self, column: pa.Array):
        words = textscan.scan(column, textscan.SPACED)
        self.words, n = words, len(words.hashes)
        opens = np.ones(n, dtype=bool)
        if n > 1:
            closed = np.isin(words.buf[words.ends[:-1] - 1], np.frombuffer(b".!?", np.uint8))
            lines = np.concatenate([[0], np.cumsum(words.buf == 10)])
            broken = lines[words.starts[1:]] > lines[words.ends[:-1]]
            opens[1:] = closed | broken | (words.rows[1:] != words.rows[:-1])
        self.first = np.flatnonzero(opens)  # first word of each sentence
        self.last = np.append(self.first[1:], n)[: len(self.first)]
        self.rows = words.rows[self.first] if n else np.empty(0, np.int64)
        self.edges = np.searchsorted(self.rows, np.arange(words.n_rows + 1))

    def spans(self, p: SubstringParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows, places, hashes, second hashes) of the spans that are long enough.

        A place is the first sentence's number times 256, plus the number of sentences.
        """
        hashes = self.words.hashes
        up, down = textscan._power_tables(len(hashes) + 1)
        total, other = np.zeros(len(hashes) + 1, dtype=np.uint64), np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=total[1:])
        np.cumsum(textscan.mix(hashes + np.uint64(0x51ED270B)) * up[: len(hashes)], out=other[1:])
        at, long = np.arange(len(self.first)), np.flatnonzero(self.last - self.first >= p.long_words)
        # Grown forwards from each sentence and backwards from each, so that every repeated stretch of min_words is covered to both ends.
        end = np.maximum(np.searchsorted(self.last, self.first + p.min_words), at + p.run - 1)
        start = np.minimum(np.searchsorted(self.first, self.last - p.min_words, side="right") - 1, at - p.run + 1)
        ahead, back = np.flatnonzero(end < len(at)), np.flatnonzero(start >= 0)
        ahead, back = ahead[self.rows[end[ahead]] == self.rows[ahead]], back[self.rows[start[back]] == self.rows[back]]
        grown = [long * 256 + 1, ahead * 256 + end[ahead] - ahead + 1, start[back] * 256 + back - start[back] + 1]
        spans = np.unique(np.concatenate(grown))
        found = []
        for run in np.unique(spans & 255):
            at = spans[(spans & 255) == run] >> 8
            a, b = self.first[at], self.last[at + run - 1]
            shape = np.full(len(at), run, dtype=np.uint64)  # where the sentences of the span end
            for k in range(run):
                shape = textscan.mix(shape + (self.last[at + k] - a).astype(np.uint64))
            one = textscan.mix((total[b] - total[a]) * down[a] + shape)
            two = textscan.mix((other[b] - other[a]) * down[a] ^ shape)
            found.append((self.rows[at], (at - self.edges[self.rows[at]]) * 256 + run, one, two))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
        return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def _check(two: np.ndarray) -> np.ndarray:
    return (two >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _repeated(docs: DataFrame, p: SubstringParams) -> DataFrame:
    """(span, check) of the spans that occur more than once: 96 bits name a span; tasks count theirs before the shuffle."""

    def run(batches):
        for batch in batches:
            for part in textscan.slices(batch, "text"):
                _, _, one, two = SentenceIndex(part.column(0)).spans(p)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(_check(two))], names=["span", "check"])

    counted = docs.select("text").mapInArrow(textscan.released(run), "span long, check int").groupBy("span", "check").count()
    return materialize(counted.where("count > 1").select("span", "check"), "substring-repeated")


def _spans(docs: DataFrame, repeated: DataFrame, p: SubstringParams) -> DataFrame:
    """(span, check, doc_id, print, place) of the spans that may be repeated ones."""
    sent = docs.sparkSession.sparkContext.broadcast(HashFilter.of(repeated, "span"))

    def run(batches):
        for batch in batches:
            for part in textscan.slices(batch, "text"):
                rows, places, one, two = SentenceIndex(part.column(2)).spans(p)
                known = sent.value.has(one)
                at = pa.array(rows[known])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at), pa.array(places[known]), pa.array(one[known].view(np.int64)), pa.array(_check(two[known]))],
                    names=["doc_id", "print", "place", "span", "check"],
                )

    schema = textscan.schema_with(docs, ["doc_id", "print"], "place long, span long, check int")
    return materialize(docs.select("doc_id", "print", "text").mapInArrow(textscan.released(run), schema), "substring-spans")


def _cut(text: str, places: list[int]) -> tuple[str, int, list[tuple[int, int]]]:
    """(text without the covered sentences, how many they are, their places)."""
    found = sentences(text)
    gone = {k for place in places for k in range(place >> 8, min((place >> 8) + (place & 255), len(found)))}
    kept = "".join(text[a:b] for k, (a, b) in enumerate(found) if k not in gone)
    merged: list[tuple[int, int]] = []
    for k in sorted(gone):
        a, b = found[k]
        if merged and merged[-1][1] == a:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    return kept, len(gone), merged


def remove_repeats(docs: DataFrame, p: SubstringParams = SubstringParams()) -> DataFrame:
    """doc_id, text, n_chars, n_sentences, n_removed, removed of each row of ``docs``.

    ``removed`` lists the places in the old text as start:end, comma-joined.
    Null texts count as empty.  Rows that repeat both id and text count as one
    document and are treated alike.  A null doc_id comes after all others;
    ids may be of any type that has an order.  Very long texts are read whole.
    Other columns are ignored whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("print", F.xxhash64("doc_id", "text"))
    spans = _spans(own, _repeated(own, p), p)
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("d"), F.col("print").alias("p"), F.col("place").alias("k"))
    # The first occurrence is the least of four plain columns, kept by an aggregation on the map side too.
    firsts = materialize(spans.groupBy("span", "check").agg(F.min(order).alias("first")), "substring-firsts").withColumnRenamed("check", "_check")
    again = skew_join(spans, firsts, "span", ["print", "place"]).where(F.col("check") == F.col("_check"))
    again = again.where(~(F.col("doc_id").eqNullSafe(F.col("first.d")) & (F.col("print") == F.col("first.p")) & (F.col("place") == F.col("first.k"))))
    places = materialize(again.groupBy("doc_id", "print").agg(F.array_sort(F.collect_set("place")).alias("places")), "substring-places")
    places = places.select(F.col("doc_id").alias("_id"), F.col("print").alias("_print"), "places")
    joined = own.join(places, (own["print"] == places["_print"]) & own["doc_id"].eqNullSafe(places["_id"]), "left").select("doc_id", "text", "places")

    def run(batches):
        for batch in batches:
            for part in textscan.slices(batch, "text"):
                texts, gone, removed = part.column(1).to_pylist(), np.zeros(part.num_rows, np.int64), [""] * part.num_rows
                total = np.diff(SentenceIndex(part.column(1)).edges)
                for row, at in enumerate(part.column(2).to_pylist()):
                    if total[row] == 0 and texts[row]:
                        total[row] = 1  # white space alone
                    if at:
                        texts[row], gone[row], where = _cut(texts[row], at)
                        removed[row] = ",".join(f"{a}:{b}" for a, b in where)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array(total),
                        pa.array(gone),
                        pa.array(removed, pa.string()),
                    ],
                    names=["doc_id", "text", "n_chars", "n_sentences", "n_removed", "removed"],
                )

    schema = textscan.schema_with(docs, ["doc_id"], "text string, n_chars long, n_sentences long, n_removed long, removed string")
    return joined.mapInArrow(textscan.released(run), schema)
