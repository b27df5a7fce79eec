"""Near-duplicate documents by a multi-index Hamming join over b-bit minwise signatures.

A document's signature holds one b-bit symbol per hash function.  The symbols
are cut into ``chunks`` equal pieces; by the pigeonhole principle two
signatures that differ in at most ``chunks * (errors + 1) - 1`` symbols have a
chunk with at most ``errors`` differing symbols.  Every way of blanking
``errors`` symbols of a chunk is enumerated as an index key, so all pairs
under that distance meet under some key; no farther pair is looked at, so the
distance and the guarantee are one.  Candidates are confirmed on full sets of
64-bit shingle hashes, so only an equal hash of different shingles (about 3 in
10**20 for each pair of them) could make a link wrong.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import textscan
from lodestrata.llm.components import connected_components
from lodestrata.llm.joins import HashFilter, skew_join
from lodestrata.runtime import materialize, ship, small_batches


@dataclass(frozen=True)
class NearDuplicateParams:
    """``percent``: links have 100 * intersection >= percent * union.

    The signature distance that is searched, completely, follows from chunks
    and errors.  A pair at the threshold similarity differs in a binomial
    number of symbols; 20 chunks of 5 symbols reach 4.9 standard deviations
    beyond its mean, which about 2 in a million such pairs exceed, and fewer
    of more similar ones.
    """

    shingle: int = 5
    percent: int = 80
    chunks: int = 20
    chunk_symbols: int = 5
    errors: int = 1
    tile: int = 512
    broadcast_rows: int = 100_000
    #: Close pairs that a tile emits for each of its rows; a tile of more is verified in place, on whole sets.
    dense: int = 8
    seed: int = 17

    def __post_init__(self):
        if self.chunk_symbols <= self.errors or len(self.kept_symbols) * self.chunks > 256:
            raise ValueError("a key keeps at least one symbol, and there are at most 256 kinds of keys")

    @property
    def kept_symbols(self) -> list[tuple[int, ...]]:
        """The symbols of a chunk that each of its keys keeps."""
        return list(combinations(range(self.chunk_symbols), self.chunk_symbols - self.errors))

    @property
    def symbols(self) -> int:
        return self.chunks * self.chunk_symbols

    @property
    def distance(self) -> int:
        """Symbols in which a pair may differ and is still certain to share a key."""
        return self.chunks * (self.errors + 1) - 1

    def multipliers(self) -> np.ndarray:
        raw = textscan.mix(np.arange(1, self.symbols + 1, dtype=np.uint64) * np.uint64(self.seed * 2 + 1))
        return raw | np.uint64(1)


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    ordered = np.sort(hashes)
    return ordered[np.append(True, ordered[1:] != ordered[:-1])] if len(ordered) else ordered


def signature(items: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """One 16-bit symbol per multiplier: bits of the least product over the set."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(items), 2048):
        part = items[at : at + 2048]
        np.minimum(least, (multipliers[:, None] * part[None, :]).min(axis=1), out=least)
    return ((textscan.mix(least) >> np.uint64(20)) & np.uint64(0xFFFF)).astype("<u2")


def _symbols(column, p: NearDuplicateParams) -> np.ndarray:
    """Packed signatures as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, p.symbols)


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in textscan.slices(batch, "text"):
        words = textscan.scan(part.column(part.schema.get_field_index("text")), textscan.SPACED)
        rows, hashes = textscan.run_hashes(words, n)
        edges = np.searchsorted(rows, np.arange(part.num_rows + 1))
        yield part, [shingle_set(hashes[edges[i] : edges[i + 1]]) for i in range(part.num_rows)]


def _digest(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def _profile(docs: DataFrame, p: NearDuplicateParams) -> DataFrame:
    """doc_id, n_shingles, digest of the set and signature, one row per document."""

    def run(batches):
        multipliers = p.multipliers()
        for batch in batches:
            for part, sets in _sets(batch, p.shingle):
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([signature(s, multipliers).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "digest", "signature"],
                )

    schema = textscan.schema_with(docs, ["doc_id"], "n_shingles long, digest binary, signature binary")
    return docs.select("doc_id", "text").mapInArrow(textscan.released(run), schema)


def _keys(nodes: DataFrame, p: NearDuplicateParams, known: HashFilter | None = None) -> DataFrame:
    """(key, node): every chunk with every choice of ``errors`` symbols blanked; with a filter, only keys that may be in it."""
    sent = nodes.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        keep = p.kept_symbols
        for batch in batches:
            if batch.num_rows == 0:
                continue
            symbols = _symbols(batch.column(1), p).reshape(-1, p.chunks, p.chunk_symbols).astype(np.uint64)
            out = np.empty((batch.num_rows, p.chunks, len(keep)), dtype=np.uint64)
            for k, chosen in enumerate(keep):
                slot = np.broadcast_to(np.arange(p.chunks, dtype=np.uint64) * np.uint64(len(keep)) + np.uint64(k), symbols.shape[:2])
                packed = slot
                for place in chosen:
                    packed = textscan.mix(packed * np.uint64(0x9E3779B97F4A7C15) + symbols[:, :, place])
                out[:, :, k] = packed << np.uint64(8) | slot  # the last byte tells the kind of key
            node = np.repeat(np.asarray(batch.column(0)), out.shape[1] * out.shape[2])
            flat = out.reshape(-1)
            if sent.value is not None:
                kept = sent.value.has(flat)
                flat, node = flat[kept], node[kept]
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(node)], names=["key", "node"])

    return nodes.select("node", "signature").mapInArrow(textscan.released(run), "key long, node long")


def _kind_of_key() -> Column:
    """The kind that a key's last byte tells; of keys with the same members the first kind counts, as it names their pairs."""
    return F.col("key").bitwiseAND(F.lit(255)).alias("kind")


def _among_outliers(outer: DataFrame, p: NearDuplicateParams) -> DataFrame:
    """Of memberships (key, node, root) those of keys with outliers of different components; keys with the same ones are compared once."""
    sets = outer.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("root").alias("r1"),
        F.max("root").alias("r2"),
        F.bit_xor(F.xxhash64("node")).alias("x1"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x2"),
    )
    chosen = sets.where("r1 <> r2").groupBy("x1", "x2", "n").agg(F.min(F.struct(_kind_of_key(), "key")).alias("k"))
    chosen = materialize(chosen.select("k.key", F.ceil(F.col("n") / p.tile).alias("outer_tiles")), "nd-among")
    rows = outer.select("key", "node", "root").join(_small(chosen, p.broadcast_rows), "key")
    return rows.withColumn("major", F.lit(None).cast("long")).withColumn("tiles", F.lit(1).cast("long"))


def _small(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast a narrow frame only if its counted rows stay under the limit."""
    return F.broadcast(df) if df.count() <= limit else df


def _close_pairs(pairs: DataFrame, nodes: DataFrame, p: NearDuplicateParams) -> DataFrame:
    """Pairs within the looked-at signature distance whose set sizes allow the similarity."""

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            near = (_symbols(batch.column(2), p) != _symbols(batch.column(3), p)).sum(axis=1) <= p.distance
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(near)), batch.column(1).filter(pa.array(near))], names=["a", "b"]
            )

    def side(name: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), F.col("signature").alias("s" + name), F.col("n_shingles").alias("n" + name))

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return (
        joined.where(100 * F.least("na", "nb") >= p.percent * F.greatest("na", "nb"))
        .select("a", "b", "sa", "sb")
        .mapInArrow(textscan.released(run), "a long, b long")
    )


class _Sets:
    """Full shingle sets of the nodes that candidates name, read from the texts when first needed."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, p: NearDuplicateParams):
        self.docs, self.nodes, self.p = docs, nodes, p
        self.have: DataFrame | None = None

    def covering(self, needed: DataFrame) -> DataFrame:
        """(node, items) of at least the needed nodes."""
        needed = needed.distinct()
        if self.have is not None:
            needed = needed.join(self.have.select("node"), "node", "left_anti")
        needed = materialize(needed.join(self.nodes.select("node", "digest", "min_doc"), "node"), "nd-needed")
        if not needed.isEmpty():
            found = materialize(self._read(needed), "nd-sets")
            self.have = found if self.have is None else self.have.union(found)
        return self.have

    def _read(self, needed: DataFrame) -> DataFrame:
        p = self.p

        def run(batches):
            for batch in batches:
                for _, sets in _sets(batch, p.shingle):
                    sets = [s for s in sets if len(s)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                        names=["digest", "items"],
                    )

        ids = needed.select(F.col("min_doc").alias("doc_id")).distinct()
        docs = self.docs.select("doc_id", "text")
        chosen = docs.join(_small(ids.dropna(), 10 * p.broadcast_rows), "doc_id", "left_semi")  # else whole texts are shuffled
        if not ids.where("doc_id is null").isEmpty():
            chosen = chosen.union(docs.where("doc_id is null"))
        found = chosen.select("text").mapInArrow(textscan.released(run), "digest binary, items binary")
        # Rows that repeat an id or a set give the same digest; one of them is enough.
        wanted = needed.select("node", "digest")
        return found.join(_small(wanted, p.broadcast_rows), "digest").groupBy("node").agg(F.first("items").alias("items"))


def _linked(x: np.ndarray, y: np.ndarray, p: NearDuplicateParams) -> bool:
    """Whether two sorted sets are as similar as links are."""
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = int((y[at] == x).sum())
    return 100 * common >= p.percent * (len(x) + len(y) - common)


def _verified(pairs: DataFrame, sets: DataFrame, p: NearDuplicateParams) -> DataFrame:
    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, (x, y) in enumerate(zip(left, right, strict=True)):
                keep[i] = _linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), p)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], names=["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("items").alias("ia"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("ib"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ia", "ib").mapInArrow(textscan.released(run), "a long, b long")


def _chain(batches) -> Iterator[pa.Table | None]:
    """The batches as tables, then None as the end."""
    for batch in batches:
        yield pa.Table.from_batches([batch])
    yield None


def _close_in_tile(group: pa.Table, p: NearDuplicateParams, once: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, distance) of a tile's close pairs of different components whose sizes allow a link.

    ``once``: only those whose first shared key is the tile's, so that every pair is named by one key.
    """
    blanks = p.kept_symbols
    key, node, root, half, size, same = (np.asarray(group.column(name)) for name in ("key", "node", "root", "half", "n_shingles", "same"))
    none = np.empty(0, np.int64)
    if (root == root[0]).all():
        return none, none, none
    sig = _symbols(group.column("signature"), p)
    out_a, out_b, out_d = [], [], []
    for i in range(len(node)) if same[0] else np.flatnonzero(half == 0):
        others = np.flatnonzero((root != root[i]) & ((node > node[i]) if same[0] else (half == 1)))
        others = others[100 * np.minimum(size[others], size[i]) >= p.percent * np.maximum(size[others], size[i])]
        equal = sig[others] == sig[i]
        far = p.symbols - equal.sum(axis=1)
        near = far <= p.distance
        others, equal, far = others[near], equal[near], far[near]
        if once:
            equal = equal.reshape(len(equal), p.chunks, p.chunk_symbols)
            shared = np.stack([equal[:, :, list(chosen)].all(axis=2) for chosen in blanks], axis=2).reshape(len(equal), p.chunks * len(blanks))
            first = shared.argmax(axis=1) == (int(key[0]) & 255)
            others, far = others[first], far[first]
        out_a.append(np.full(len(others), i))
        out_b.append(others)
        out_d.append(far)
    return tuple(np.concatenate(part) if part else none for part in (out_a, out_b, out_d))


def _with_signatures(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Memberships with their node's signature and size; a node's memberships, one for each key at most, meet them as one list."""
    other = [c for c in rows.columns if c != "node"]
    lists = rows.groupBy("node").agg(F.collect_list(F.struct(*other)).alias("_rows"))
    return lists.join(nodes.select("node", "signature", "n_shingles"), "node").select("node", "signature", "n_shingles", F.inline("_rows"))


def _dealt(members: DataFrame, visiting: bool) -> DataFrame:
    """Members of keys dealt to tiles of bounded size: (key, inner, t1, t2, node, root, half, same) and, if given, signature and n_shingles.

    A key's members of its largest component stay in one tile each; its other
    members visit each of those tiles, if they are among the rows
    (``visiting``), and the pairs of tiles that they make up themselves.
    """
    inside = F.coalesce(F.col("root") == F.col("major"), F.lit(False))
    own = F.pmod(F.xxhash64("node"), F.when(inside, F.col("tiles")).otherwise(F.col("outer_tiles"))).cast("int")
    place = F.struct
    zero, one = F.lit(0), F.lit(1)
    stay = F.array(place(zero.alias("inner"), F.col("own").alias("t1"), zero.alias("t2"), zero.alias("half"), zero.alias("same")))
    visits = F.transform(
        F.sequence(zero, F.col("tiles").cast("int") - 1),
        lambda t: place(zero.alias("inner"), t.alias("t1"), zero.alias("t2"), one.alias("half"), zero.alias("same")),
    )
    among = F.transform(
        F.sequence(zero, F.col("outer_tiles").cast("int") - 1),
        lambda t: place(
            one.alias("inner"),
            F.least(t, F.col("own")).alias("t1"),
            F.greatest(t, F.col("own")).alias("t2"),
            (F.col("own") > t).cast("int").alias("half"),
            (F.col("own") == t).cast("int").alias("same"),
        ),
    )
    return members.withColumn("own", own).select(
        "key",
        "node",
        "root",
        *(c for c in ("signature", "n_shingles") if c in members.columns),
        F.inline(F.when(inside, stay).otherwise(F.concat(visits, among) if visiting else among)),
    )


_TILE = ("key", "inner", "t1", "t2")


def _cross_pairs(dealt: DataFrame, p: NearDuplicateParams, nearest: int | None) -> DataFrame:
    """(a, b, key, inner, t1, t2): candidate pairs of different components, compared on signatures tile by tile.

    With ``nearest``, each node outside the largest component emits just its
    nearest partners.  Without, a tile emits its close pairs, at most ``dense``
    for each of its rows; a tile of more emits only its own name (no a and b).
    """

    def run(batches):
        for group in _groups(batches, _TILE):
            if group.num_rows < 2:
                continue
            x, y, far = _close_in_tile(group, p, once=nearest is None)
            node, tile = np.asarray(group.column("node")), [group.column(name)[0].as_py() for name in _TILE]
            full = nearest is None and len(x) > p.dense * group.num_rows
            if nearest is not None and len(x):
                ends, pair, weight = np.concatenate([x, y]), np.tile(np.arange(len(x)), 2), np.concatenate([far, far])
                asks = (np.asarray(group.column("half"))[ends] == 1) | bool(tile[1])
                ends, pair, weight = ends[asks], pair[asks], weight[asks]
                order = np.lexsort((pair, weight, ends))
                ends, pair = ends[order], pair[order]
                pair = np.unique(pair[np.arange(len(ends)) - np.searchsorted(ends, ends) < nearest])
                x, y = x[pair], y[pair]
            a, b = (pa.nulls(1, pa.int64()),) * 2 if full else (pa.array(np.minimum(node[x], node[y])), pa.array(np.maximum(node[x], node[y])))
            named = [pa.array([value] * len(a), pa.int64() if name == "key" else pa.int32()) for name, value in zip(_TILE, tile, strict=True)]
            yield pa.RecordBatch.from_arrays([a, b, *named], names=["a", "b", *_TILE])

    return _in_tiles(dealt).mapInArrow(textscan.released(run), "a long, b long, key long, inner int, t1 int, t2 int")


def _in_tiles(dealt: DataFrame) -> DataFrame:
    return dealt.repartition(*_TILE).sortWithinPartitions(*_TILE)


def _dense_links(tiles: DataFrame, dealt: DataFrame, nodes: DataFrame, sets: DataFrame, p: NearDuplicateParams) -> DataFrame:
    """(a, b): true links of the named tiles, found on whole sets in place; of each tile only as many as join its rows."""

    def run(batches):
        for group in _groups(batches, _TILE):
            node = np.asarray(group.column("node"))
            items = [np.frombuffer(x, np.uint64) for x in group.column("items").to_pylist()]
            up = list(range(len(node)))

            def find(i: int, up: list[int] = up) -> int:
                while up[i] != i:
                    up[i] = up[up[i]]
                    i = up[i]
                return i

            roots: dict[int, int] = {}
            for i, root in enumerate(np.asarray(group.column("root")).tolist()):
                up[i] = roots.setdefault(root, i)  # known components are joined already
            a, b = [], []
            x, y, far = _close_in_tile(group, p, once=True)
            for k in np.argsort(far, kind="stable").tolist():
                i, j = find(int(x[k])), find(int(y[k]))
                if i != j and _linked(items[x[k]], items[y[k]], p):
                    up[j] = i
                    a.append(min(node[x[k]], node[y[k]]))
                    b.append(max(node[x[k]], node[y[k]]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = dealt.join(_small(tiles, p.broadcast_rows), list(_TILE))
    rows = rows.join(_whole(rows, nodes, sets), "node")
    return _in_tiles(rows).mapInArrow(textscan.released(run), "a long, b long")


def _whole(rows: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, signature, n_shingles, items) of the nodes among the rows, put together once for each node."""
    wanted = nodes.join(rows.select("node").distinct(), "node", "left_semi")
    return wanted.select("node", "signature", "n_shingles").join(sets, "node")


def _groups(batches, keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Whole groups of rows that are sorted by the keys."""
    held: pa.Table | None = None
    for batch in _chain(batches):
        table = held if batch is None else batch if held is None else pa.concat_tables([held, batch])
        if table is None or table.num_rows == 0:
            continue
        values = np.stack([np.asarray(table.column(name)) for name in keys])
        edges = np.concatenate([[0], np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1, [table.num_rows]])
        if batch is not None:  # the last group may go on in the next batch
            held = table.slice(edges[-2])
            edges = edges[:-1]
        for at, to in zip(edges[:-1], edges[1:], strict=True):
            yield table.slice(at, to - at)


def _outlier_links(visits: DataFrame, stays: DataFrame, nodes: DataFrame, sets: DataFrame, p: NearDuplicateParams) -> DataFrame:
    """At most one true link of each visiting node into each tile of a component.

    Components and their visitors are dealt to tiles of bounded size; a tile
    holds whole sets, so it is exact and only links leave it.
    """

    def run(batches):
        for group in _groups(batches, ("root", "t1", "t2")):
            half = np.asarray(group.column("visitor"))
            node, size = np.asarray(group.column("node")), np.asarray(group.column("n_shingles"))
            own, guests = np.flatnonzero(half == 0), np.flatnonzero(half == 1)
            if len(own) == 0 or len(guests) == 0:
                continue
            sig = _symbols(group.column("signature"), p)
            items = [np.frombuffer(x, np.uint64) for x in group.column("items").to_pylist()]
            a, b = [], []
            for guest in guests:
                far = (sig[own] != sig[guest]).sum(axis=1)
                fits = (far <= p.distance) & (100 * np.minimum(size[own], size[guest]) >= p.percent * np.maximum(size[own], size[guest]))
                for other in own[fits][np.argsort(far[fits], kind="stable")]:
                    if _linked(items[guest], items[other], p):
                        a.append(min(node[guest], node[other]))
                        b.append(max(node[guest], node[other]))
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def tiles(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / p.tile).cast("int").alias(name))

    sizes = materialize(tiles(stays, "n1").join(tiles(visits, "n2"), "root"), "nd-sizes")

    def dealt(df: DataFrame, visitor: int, own: str, other: str) -> DataFrame:
        place = F.pmod(F.xxhash64("node"), F.col(own)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        rows = skew_join(df, sizes, "root", ["node"]).select("root", "node", place.alias("t1" if visitor == 0 else "t2"), each.alias("t2" if visitor == 0 else "t1"))
        return rows.select("root", "t1", "t2", "node", F.lit(visitor).alias("visitor"))

    rows = dealt(stays, 0, "n1", "n2").unionByName(dealt(visits, 1, "n2", "n1"))
    rows = rows.join(_whole(visits.union(stays), nodes, sets), "node")
    rows = rows.select("root", "t1", "t2", "visitor", "node", "n_shingles", "signature", "items")
    return rows.repartition("root", "t1", "t2").sortWithinPartitions("root", "t1", "t2").mapInArrow(textscan.released(run), "a long, b long")


def _mixed_keys(rooted: DataFrame, p: NearDuplicateParams) -> DataFrame:
    """(key, major, n, tiles, outer_tiles) of the keys of several components; major is the one with most members there."""
    # Keys with the same members are compared once.
    by_root = rooted.groupBy("key", "root").agg(
        F.count(F.lit(1)).alias("here"), F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x2")
    )
    mixed = by_root.groupBy("key").agg(
        F.count(F.lit(1)).alias("roots"),
        F.sum("here").alias("n"),
        F.max("here").alias("largest"),
        F.max_by("root", "here").alias("major"),
        F.bit_xor("x1").alias("x1"),
        F.bit_xor("x2").alias("x2"),
    )
    mixed = (
        mixed.where("roots > 1")
        .groupBy("x1", "x2", "n")
        .agg(F.min(F.struct(_kind_of_key(), "key", "major", "largest")).alias("k"))
        .select(
            "k.key",
            "k.major",
            "n",
            F.ceil(F.col("k.largest") / p.tile).alias("tiles"),
            F.ceil((F.col("n") - F.col("k.largest")) / p.tile).alias("outer_tiles"),
        )
    )
    return materialize(mixed, "nd-mixed")


def near_duplicate_classes(docs: DataFrame, p: NearDuplicateParams = NearDuplicateParams()) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): each document's set digest, and each distinct set's component.

    rows: doc_id, n_shingles, digest (null for an empty set).
    classes: digest, root, component_id (least non-null doc_id of the component).
    """
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    rows = materialize(_profile(docs, p), "nd-rows")
    classes = (
        rows.where("digest is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("min_doc"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    nodes = materialize(classes, "nd-nodes")  # written once, so the node numbers stay as they are
    # Many small tasks keep the hash maps of the first aggregation small.
    spread = nodes.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = _keys(spread, p).groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("n"))
    shared = materialize(shared.where("n > 1"), "nd-keys")
    # Of the keys of more than two nodes all members are needed; a filter of bounded size leaves out the others before the join.
    crowded = shared.where("n > 2").select("key", "lo")
    again = _keys(spread, p, HashFilter.of(crowded, "key"))
    members = materialize(again.join(_small(crowded, p.broadcast_rows), "key"), "nd-members")
    pairs = shared.select(F.col("lo").alias("a"), F.col("hi").alias("b")).union(
        members.where("node <> lo").select(F.col("lo").alias("a"), F.col("node").alias("b"))
    )
    sets = _Sets(docs, nodes, p)
    links: list[DataFrame] = []

    def confirm(candidates: DataFrame, name: str) -> float:
        """Keep the true links of the candidates; returns their share."""
        close = materialize(candidates, name)
        tested = close.count()
        if tested == 0:
            return 0.0
        ends = close.select(F.col("a").alias("node")).union(close.select("b"))
        links.append(materialize(_verified(close, sets.covering(ends), p), name + "-links"))
        return links[-1].count() / tested

    confirm(_close_pairs(pairs.distinct(), nodes, p), "nd-star")
    # Nearest partners first, while that joins many; then all close pairs that are left across components.
    nearest: int | None = 2
    changed = True
    while True:
        if changed:  # a round without links leaves components, and all that is made of them, as they are
            rooted = members.select("key", "node")
            if links:
                known = connected_components(reduce(DataFrame.union, links))
                rooted = rooted.join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
            else:
                rooted = rooted.withColumn("root", F.col("node"))
            rooted = materialize(rooted, "nd-roots")
            mixed = _mixed_keys(rooted, p)
            if mixed.isEmpty():
                break
            open_members = rooted.join(_small(mixed, p.broadcast_rows), "key")
            # Several steps read these; a node has a row for each of its mixed keys, of at most one for each kind.
            outer = materialize(open_members.where("root <> major"), "nd-outer")
        if nearest is not None:  # each node outside the largest component asks in its most crowded key
            asked = materialize(outer.groupBy("node").agg(F.max_by("key", F.struct("n", "key")).alias("key")), "nd-asked")
            held = open_members.where("root = major").join(asked.select("key").distinct(), "key", "left_semi")
            asking = held.unionByName(outer.join(asked, ["node", "key"], "left_semi"))
        else:  # the rest: against the largest components by whole sets, and among each other by close pairs
            visits = materialize(outer.select("node", F.col("major").alias("root")).distinct(), "nd-visits")
            stays = materialize(open_members.where("root = major").select("node", "root").distinct(), "nd-stays")
            whole = sets.covering(visits.select("node").union(stays.select("node")))
            links.append(materialize(_outlier_links(visits, stays, nodes, whole, p), "nd-outlier-links"))
            among = _among_outliers(outer, p)
            found = materialize(_cross_pairs(_dealt(_with_signatures(among, nodes), visiting=False), p, None), "nd-cross")
            tiles = materialize(found.where("a is null").select(*_TILE), "nd-dense")
            if not tiles.isEmpty():
                links.append(materialize(_dense_links(tiles, _dealt(among, visiting=False), nodes, whole, p), "nd-dense-links"))
            confirm(found.where("a is not null").select("a", "b"), "nd-sparse")
            break
        share = confirm(_cross_pairs(_dealt(_with_signatures(asking, nodes), visiting=True), p, nearest).select("a", "b"), "nd-cross")
        nearest = nearest if share >= 0.05 else None
        changed = share > 0
    if links:
        known = connected_components(reduce(DataFrame.union, links))
        labelled = nodes.select("digest", "node", "min_doc").join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    else:
        labelled = nodes.select("digest", "node", "min_doc").withColumn("root", F.col("node"))
    names = labelled.groupBy("root").agg(F.min("min_doc").alias("component_id"))
    return rows, skew_join(labelled, materialize(names, "nd-names"), "root", ["node"]).select("digest", "root", "component_id")


def near_duplicates(docs: DataFrame, p: NearDuplicateParams = NearDuplicateParams()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    Needs the columns doc_id and text; others are ignored whatever their names.
    A null or wordless text has an empty set and is linked with nothing.
    Repeated rows give repeated rows.  A null doc_id links like any other but
    names no component unless no member has an id.  An empty table gives an
    empty result.  Ids may be of any type that has an order.  Very long texts
    are read whole.
    """
    rows, classes = near_duplicate_classes(docs, p)
    found = rows.select("doc_id", "n_shingles", "digest").join(classes.select("digest", F.col("component_id").alias("c")), "digest", "left")
    return found.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("c")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, p: NearDuplicateParams = NearDuplicateParams()) -> DataFrame:
    """``docs`` with one document of each group; columns are unchanged.

    The member with the least doc_id stays.  Of rows that repeat that id, those
    with the same text count once.
    """
    decisions = materialize(near_duplicates(docs, p), "nd-decisions")
    kept = decisions.where("kept").select(F.col("doc_id").alias("_id"))
    repeats = not kept.groupBy("_id").count().where("count > 1").isEmpty()
    # The ids to drop are far fewer than those to keep; within the bound the texts then need no shuffle.
    other = decisions.where("not kept").select(F.col("doc_id").alias("_id")).distinct().alias("d")
    ids = kept.distinct().alias("k")
    gone = materialize(other.join(ids, F.col("d._id").eqNullSafe(F.col("k._id")), "left_anti").select(F.col("d._id").alias("_id")), "nd-dropped")
    same: Column = docs["doc_id"].eqNullSafe(gone["_id"])
    left = docs.join(_small(gone, 10 * p.broadcast_rows), same, "left_anti")
    return left.dropDuplicates(["doc_id", "text"]) if repeats else left
