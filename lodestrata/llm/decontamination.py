"""Benchmark decontamination by a prefix-filtered containment join.

Every benchmark item is cut into windows of consecutive words.  A window's
words are ordered by rarity, counted over all documents; for full containment
the two rarest, at their distance, are a prefix that every document with the
window must hold.  Prefixes join the documents' words at that distance, and
each such place is checked for the window's length, its position and then word
by word.  Windows, prefixes and candidates are tables; only hash filters of
bounded size go to the driver and the executors.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import textscan
from lodestrata.llm.joins import HashFilter, skew_join
from lodestrata.runtime import materialize, ship, small_batches

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


@dataclass(frozen=True)
class DecontaminationParams:
    """``filter_bits``: the filters of benchmark words and prefixes have at most 2 to this power bits.

    ``broadcast_rows``: windows up to this number go to every executor; more are shuffled.
    """

    window: int = 10
    filter_bits: int = 26
    broadcast_rows: int = 50_000


def _pair(first: np.ndarray, second: np.ndarray, distance: np.ndarray | int) -> np.ndarray:
    """The hash of two words at a distance."""
    there = textscan.mix(second + np.uint64(0x9E3779B97F4A7C15) * np.asarray(distance, dtype=np.int64).astype(np.uint64))
    return textscan.mix(first * np.uint64(0xD6E8FEB86659FD93) + there)


def _windows(benchmark: DataFrame, p: DecontaminationParams) -> DataFrame:
    """(item, w, spelled, words): each window of each item, named by its digest, with the hashes of its words."""

    def run(batches):
        for batch in batches:
            for part in textscan.slices(batch, "text", 1 << 16):
                words = textscan.scan(part.column(1), textscan.ALNUM)
                text = words.buf.tobytes().translate(_LOWER)
                first = words.bounds()
                rows, spelled, hashes = [], [], []
                for row in range(part.num_rows):
                    span = [text[a:b] for a, b in zip(words.starts[first[row] : first[row + 1]], words.ends[first[row] : first[row + 1]], strict=True)]
                    for at in range(max(1, len(span) - p.window + 1) if span else 0):
                        rows.append(row)
                        spelled.append(b" ".join(span[at : at + p.window]))
                        hashes.append(words.hashes[first[row] + at : first[row] + min(at + p.window, len(span))].view(np.int64))
                columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(spelled, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "spelled", "words"])

    items = benchmark.select(F.col("item_id").alias("item"), "text").where("text is not null")
    schema = textscan.schema_with(items, ["item"], "spelled binary, words array<long>")
    return items.mapInArrow(textscan.released(run), schema).withColumn("w", F.md5("spelled"))


def _frequencies(docs: DataFrame, vocabulary: DataFrame, p: DecontaminationParams) -> DataFrame:
    """(word, n): in how many documents benchmark words occur, over all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(HashFilter.of(vocabulary, "word", p.filter_bits))

    def run(batches):
        for batch in batches:
            for part in textscan.slices(batch, "text"):
                words = textscan.scan(part.column(0), textscan.ALNUM)
                known = sent.value.has(words.hashes)
                order = np.lexsort((words.rows[known], words.hashes[known]))
                hashes, rows = words.hashes[known][order], words.rows[known][order]
                fresh = np.ones(len(hashes), dtype=bool)
                fresh[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
                found, n = np.unique(hashes[fresh], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    counted = docs.select("text").mapInArrow(textscan.released(run), "word long, n long")
    return materialize(counted.groupBy("word").agg(F.sum("n").alias("n")).join(vocabulary, "word", "left_semi"), "dc-frequencies")


def _prefixes(windows: DataFrame, docs: DataFrame, p: DecontaminationParams) -> DataFrame:
    """(key, w, spelled, n, at, word): of each distinct window its two rarest words at their distance, and where the rarest lies."""
    places = materialize(windows.select("w", F.posexplode("words").alias("at", "word")), "dc-places")
    frequency = _frequencies(docs, places.select("word").distinct(), p)
    # Words that no document holds count as rarest; a frequent word's places are dealt to salted keys.
    counted = skew_join(places, frequency, "word", ["w", "at"], p.broadcast_rows)
    ranked = places.join(counted.select("w", "at", "n"), ["w", "at"], "left").groupBy("w")
    ranked = ranked.agg(F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at"))), 1, 2).alias("least"))

    def run(batches):
        for batch in batches:
            least = batch.column(3).to_pylist()
            one = np.array([x[0]["at"] for x in least], dtype=np.int64)
            two = np.array([x[-1]["at"] for x in least], dtype=np.int64)
            words = batch.column(2)
            flat, edge = np.asarray(words.flatten()).view(np.uint64), np.asarray(words.offsets)[:-1] - words.offsets[0].as_py()
            first = flat[edge + one]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_pair(first, flat[edge + two], two - one).view(np.int64)),
                    *batch.columns[:2],
                    pa.array(np.asarray(words.value_lengths()).astype(np.int32)),
                    pa.array(one.astype(np.int32)),
                    pa.array(first.view(np.int64)),
                ],
                names=["key", "w", "spelled", "n", "at", "word"],
            )

    joined = windows.join(ranked, "w").select("w", "spelled", "words", "least")
    return materialize(joined.mapInArrow(textscan.released(run), "key long, w string, spelled binary, n int, at int, word long"), "dc-prefixes")


def _candidates(docs: DataFrame, keep: list[str], prefixes: DataFrame, p: DecontaminationParams) -> DataFrame:
    """The kept columns, n_words and found: the places of each text that may hold a prefix, with the words around them."""
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((HashFilter.of(prefixes, "word", p.filter_bits), HashFilter.of(prefixes, "key", p.filter_bits)))
    reach = p.window - 1
    place = pa.struct([("key", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("text", pa.binary())])

    def run(batches):
        rare, pairs = sent.value
        for batch in batches:
            for part in textscan.slices(batch, "text"):
                words = textscan.scan(part.column(len(keep)), textscan.ALNUM)
                first, h, size = words.bounds(), words.hashes, len(words.hashes)
                near = np.flatnonzero(rare.has(h))
                where, keys = [], []
                for distance in range(-reach, reach + 1):
                    other = near + distance
                    inside = (other >= 0) & (other < size)
                    one, two = near[inside], other[inside]
                    same = words.rows[one] == words.rows[two]
                    one, two = one[same], two[same]
                    key = _pair(h[one], h[two], distance)
                    hit = pairs.has(key)
                    where.append(one[hit])
                    keys.append(key[hit])
                at, key = np.concatenate(where), np.concatenate(keys)
                order = np.argsort(at, kind="stable")
                at, key = at[order], key[order]
                row = words.rows[at]
                low, high = np.maximum(at - reach, first[row]), np.minimum(at + reach, first[row + 1] - 1)
                buf = words.buf
                texts = [buf[a:b].tobytes() for a, b in zip(words.starts[low].tolist(), words.ends[high].tolist(), strict=True)]
                fields = [pa.array(key.view(np.int64)), pa.array(at - first[row]), pa.array((at - low).astype(np.int32)), pa.array(texts, pa.binary())]
                offsets = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
                found = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, fields=list(place)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(np.diff(first)), found], names=[*keep, "n_words", "found"])

    schema = textscan.schema_with(docs, keep, "n_words long, found array<struct<key: long, at: long, before: int, text: binary>>")
    return docs.mapInArrow(textscan.released(run), schema)


def _occurrences(rows: DataFrame, prefixes: DataFrame, p: DecontaminationParams) -> DataFrame:
    """(r, start, n, w): the windows that occur, verified word by word; ``rows`` has r and found."""
    asked = rows.where(F.size("found") > 0).select("r", F.inline("found"))
    joined = skew_join(asked, prefixes.select("key", "w", "spelled", "n", F.col("at").alias("offset")), "key", ["r", "at"], p.broadcast_rows)

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            before, offset, n, text, spelled = (batch.column(name).to_pylist() for name in ("before", "offset", "n", "text", "spelled"))
            for i in range(batch.num_rows):
                begin = before[i] - offset[i]
                if begin >= 0:  # the window's first word lies in the text
                    words = _WORDS.findall(text[i].translate(_LOWER))[begin : begin + n[i]]
                    keep[i] = b" ".join(words) == spelled[i]
            at = np.asarray(batch.column("at")) - np.asarray(batch.column("offset"))
            chosen = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [batch.column("r").filter(chosen), pa.array(at[keep]), batch.column("n").filter(chosen), batch.column("w").filter(chosen)], names=["r", "start", "n", "w"]
            )

    return materialize(joined.mapInArrow(textscan.released(run), "r long, start long, n int, w string").distinct(), "dc-occurrences")


def _search(docs: DataFrame, keep: list[str], benchmark: DataFrame, p: DecontaminationParams, every_row: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, occurrences, owners): rows have r, the kept columns and n_words; without ``every_row``, only those that may be hit."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    windows = materialize(_windows(benchmark, p), "dc-windows")
    prefixes = _prefixes(windows.dropDuplicates(["w"]).select("w", "spelled", "words"), docs, p)
    rows = _candidates(docs, keep, prefixes, p)
    if not every_row:
        rows = rows.where(F.size("found") > 0)
    rows = materialize(rows.withColumn("r", F.monotonically_increasing_id()), "dc-rows")  # written once, so the numbers stay
    return rows, _occurrences(rows.select("r", "found"), prefixes, p), windows.select("w", "item")


def mark_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], p: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """The ``keep`` columns, n_words, n_hit and items (item ids as strings, sorted) of each row.

    Null texts have no words.  Items without words have no windows; an item
    whose id is null marks words but is not listed.  An item id that several
    rows share is listed once.  Ids may be of any type.  Repeated rows give
    repeated rows; other columns are ignored whatever their names.  Very long
    texts are read whole; an empty table on either side gives no hits.
    """
    names = [f"k{i}" for i in range(len(keep))]  # no input column clashes with what is added
    own = docs.select(*[docs[c].alias(n) for c, n in zip(keep, names, strict=True)], docs["text"].alias("text"))
    rows, occurrences, owners = _search(own, names, benchmark, p, every_row=True)
    span = F.struct("start", (F.col("start") + F.col("n")).alias("end"))
    fold = F.aggregate(
        F.array_sort(F.collect_set(span)),
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("reach")),
        lambda s, x: F.struct(
            (s["hit"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["start"], s["reach"]))).alias("hit"),
            F.greatest(s["reach"], x["end"]).alias("reach"),
        ),
        lambda s: s["hit"],
    )
    hits = occurrences.groupBy("r").agg(fold.alias("n_hit"))
    owners = owners.where("item is not null").select("w", F.col("item").cast("string").alias("item")).distinct()
    pairs = materialize(occurrences.select("r", "w").distinct(), "dc-pairs")
    named = skew_join(pairs, owners, "w", ["r"], p.broadcast_rows).groupBy("r").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    found = rows.join(hits, "r", "left").join(named, "r", "left")
    return found.select(*names, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items")).toDF(
        *keep, "n_words", "n_hit", "items"
    )


def contamination_report(docs: DataFrame, benchmark: DataFrame, p: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of ``docs``; see ``mark_contamination``."""
    return mark_contamination(docs.select("doc_id", "text"), benchmark, ["doc_id"], p).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, p: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """``docs`` without the rows in which a benchmark window occurs; columns are unchanged.

    Rows are known by 128 bits of their text, so copies go together.  Null
    texts stay.
    """
    one, two = F.xxhash64(docs["text"]), F.xxhash64(F.lit(7), docs["text"])
    own = docs.select(one.alias("k0"), two.alias("k1"), docs["text"].alias("text"))
    rows, occurrences, _ = _search(own, ["k0", "k1"], benchmark, p, every_row=False)
    hit = materialize(rows.join(occurrences.select("r").distinct(), "r", "left_semi").select("k0", "k1").distinct(), "dc-hit")
    hit = F.broadcast(hit) if hit.count() <= 1_000_000 else hit
    return docs.join(hit, (one == hit["k0"]) & (two == hit["k1"]), "left_anti")


def digest_of(item_ids: list[int]) -> str:
    """The digest that a report holds for these items."""
    return hashlib.sha256(",".join(sorted(map(str, item_ids))).encode()).hexdigest()
