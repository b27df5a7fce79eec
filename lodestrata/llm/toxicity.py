"""Toxicity scores: averaged subword-bag embeddings under a linear softmax.

Every word is the mean of the embeddings of its character n-grams (with word
boundaries) and of the word itself, all hashed into one table; a document is
the mean of its words.  Embeddings and softmax are trained jointly in numpy.
As the model is linear after the averages, a trained model is one number per
bucket, and scoring is a table look-up per n-gram.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import textscan
from lodestrata.runtime import materialize, ship, small_batches


@dataclass(frozen=True)
class ToxicityParams:
    """``max_per_class``: bound on the labelled rows of each class that are fitted.

    ``max_bytes``: bound on their bytes of text together; fewer rows are drawn
    where texts are long.  Whole texts are fitted, in one task.
    """

    orders: tuple[int, ...] = (3, 4, 5)
    bucket_bits: int = 18
    dim: int = 2
    max_per_class: int = 3000
    max_bytes: int = 16_000_000
    min_docs: int = 40
    rounds: int = 150
    rate: float = 3.0
    decay: float = 1e-5
    damping: float = 15.0
    aside: float = 0.15
    seed: int = 11
    threshold: float = 0.7


_K = np.uint32(0x01000193)
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[~textscan.ALNUM.is_word] = 0
_FOLD = (_FOLD * np.uint32(2654435761) ^ np.uint32(0x5BD1E995)).astype(np.uint32)


def _running(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(x, out=out[1:])
    return out


class SubwordBags:
    """Bucket numbers of every n-gram of every word of a text column."""

    def __init__(self, column: pa.Array, p: ToxicityParams):
        buf, offsets = textscan.utf8(column)
        rows = len(offsets) - 1
        padded = np.full(len(buf) + rows + 1, 32, dtype=np.uint8)
        for row in range(rows):
            padded[offsets[row] + row + 1 : offsets[row + 1] + row + 1] = buf[offsets[row] : offsets[row + 1]]
        inside = textscan.ALNUM.is_word[padded]
        step = np.diff(inside.view(np.int8))
        self.starts = np.flatnonzero(step == 1) + 1
        self.ends = np.flatnonzero(step == -1) + 1
        edges = offsets + np.arange(rows + 1)
        self.rows = np.searchsorted(edges, self.starts, side="right") - 1
        self.n_rows, self.p = rows, p
        self.value, self.inside = _FOLD[padded], inside
        length = self.ends - self.starts
        self.counts = np.ones(len(length), dtype=np.int64)
        for n in p.orders:
            self.counts += np.maximum(length + 3 - n, 0)

    def orders(self):
        """(valid windows, buckets) of each order, then of whole words."""
        shift = np.uint32(32 - self.p.bucket_bits)
        n_max = max(self.p.orders)
        size = len(self.value)
        hashes = self.value.copy()
        for n in range(2, n_max + 1):
            if size < n:
                return
            hashes = hashes[: size - n + 1] * _K + self.value[n - 1 :]
            if n in self.p.orders:
                valid = np.ones(size - n + 1, dtype=bool)
                for k in range(1, n - 1):
                    valid &= self.inside[k : size - n + 1 + k]
                yield n, valid, ((hashes * np.uint32(2246822519) + np.uint32(n)) * np.uint32(2654435761)) >> shift

    def word_names(self) -> np.ndarray:
        """A 64-bit hash of the letters of each word, in their order."""
        up, down = textscan._power_tables(len(self.value) + 1)
        total = _running(self.value.astype(np.uint64) * up[: len(self.value)])
        return textscan.mix((total[self.ends] - total[self.starts]) * down[self.starts])

    def word_buckets(self) -> np.ndarray:
        return (self.word_names() >> np.uint64(64 - self.p.bucket_bits)).astype(np.int64)

    def word_means(self, table: np.ndarray) -> np.ndarray:
        """Mean of a per-bucket number over each word's bag."""
        if len(self.starts) == 0:
            return np.empty(0)
        total = table[self.word_buckets()].astype(np.float64)
        for _, valid, buckets in self.orders():
            values = np.where(valid, table[buckets], np.float32(0))
            at = np.minimum(self.starts - 1, len(values) - 1)
            sums = np.add.reduceat(values, at, dtype=np.float64)
            sums[(self.starts - 1) >= len(values)] = 0
            total += sums
        return total / self.counts

    def row_sums(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums of the words' means, numbers of words) by row."""
        words = np.bincount(self.rows, minlength=self.n_rows)
        return np.bincount(self.rows, weights=self.word_means(table), minlength=self.n_rows), words


class ToxicityModel:
    """One number per bucket, and the intercept of the softmax difference."""

    def __init__(self, table: np.ndarray, bias: float, params: ToxicityParams):
        self.table, self.bias, self.params = table.astype(np.float32), float(bias), params

    def logits(self, column: pa.Array) -> np.ndarray:
        sums, words = SubwordBags(column, self.params).row_sums(self.table) if len(column) != 1 else self._long(column)
        return sums / np.maximum(words, 1) + self.bias

    def _long(self, column: pa.Array, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """The sums of one text, piece by piece, cut between words."""
        total, n = np.zeros(1), np.zeros(1, dtype=np.int64)
        for part in textscan.pieces(column, textscan.ALNUM, piece):
            sums, words = SubwordBags(part, self.params).row_sums(self.table)
            total, n = total + sums, n + words
        return total, n

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(column), -30, 30)))


def _csr(row: np.ndarray, col: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(row, kind="stable")
    return col[order], np.searchsorted(row[order], np.arange(n_rows + 1))


def _sum_rows(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    out = np.zeros((len(edges) - 1, values.shape[1]), dtype=np.float32)
    full = np.flatnonzero(np.diff(edges) > 0)
    for column in range(values.shape[1] if len(full) else 0):  # contiguous columns sum faster
        out[full, column] = np.add.reduceat(np.ascontiguousarray(values[:, column]), edges[full])
    return out


def distinct_texts(texts: list[str], labels: np.ndarray, run: int = 4, bands: int = 12, rows: int = 3, least: float = 0.8) -> np.ndarray:
    """Numbers of the texts that are no copies or near copies of an earlier one with their label.

    Near copies share at least ``least`` of their runs of words, counted on the
    whole sets; minwise values in bands propose the pairs, and texts that only
    share a passage stay.
    """
    factors = textscan.mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    seen: list[dict[tuple, list[int]]] = [{} for _ in range(bands)]
    sets: dict[int, np.ndarray] = {}
    kept = []
    for number, text in enumerate(texts):
        _, hashes = textscan.run_hashes(textscan.scan(pa.array([text], pa.large_string()), textscan.ALNUM), run)
        own = np.unique(hashes)
        sketch = [int((own * f).min()) for f in factors] if len(own) else [0] * len(factors)
        keys = [(int(labels[number]), *sketch[band * rows : (band + 1) * rows]) for band in range(bands)]
        near = {other for key, known in zip(keys, seen, strict=True) for other in known.get(key, ())}
        common = ((other, len(np.intersect1d(own, sets[other], assume_unique=True))) for other in near)
        if any(n >= least * (len(own) + len(sets[other]) - n) for other, n in common):
            continue
        kept.append(number)
        sets[number] = own
        for key, known in zip(keys, seen, strict=True):
            known.setdefault(key, []).append(number)
    return np.array(kept, dtype=np.int64)


def fit(texts: list[str], labels: np.ndarray, p: ToxicityParams = ToxicityParams(), prior: float | None = None) -> ToxicityModel:
    """Train on most of the labelled texts, then calibrate the scores on the others.

    ``prior``: share of toxic rows among all labelled rows, if the sample was
    drawn by class.
    """
    labels = np.asarray(labels, dtype=np.int64)
    kept = distinct_texts(texts, labels)
    texts, labels = [texts[i] for i in kept], labels[kept]
    order = np.random.default_rng(p.seed).permutation(len(labels))
    aside = np.zeros(len(labels), dtype=bool)
    aside[order[: int(len(labels) * p.aside)]] = True
    model = _train([t for t, out in zip(texts, aside, strict=True) if not out], labels[~aside], p)
    truth = labels[aside]
    if len(truth) < 40 or truth.min() == truth.max() or not model.table.any():
        return model
    others = [t for t, out in zip(texts, aside, strict=True) if out]
    logit = np.concatenate([model.logits(pa.array(others[at : at + 64], pa.large_string())) for at in range(0, len(others), 64)])
    spread = float(logit.std()) or 1.0
    logit = logit / spread
    prior = truth.mean() if prior is None else prior
    weight = np.where(truth == 1, prior / truth.mean(), (1 - prior) / (1 - truth.mean()))
    design = np.stack([logit, np.ones_like(logit)], axis=1)
    line = np.zeros(2)
    for _ in range(30):  # Newton steps of a two-parameter logistic regression, slightly ridged
        guess = 1 / (1 + np.exp(-np.clip(design @ line, -30, 30)))
        slope = design.T @ (weight * (guess - truth)) + 1e-3 * line
        curve = (design * (weight * guess * (1 - guess))[:, None]).T @ design + 1e-3 * np.eye(2)
        line = line - np.clip(np.linalg.solve(curve, slope), -1, 1)
    line[0] /= spread
    if line[0] <= 0:
        return model
    return ToxicityModel(model.table * line[0], model.bias * line[0] + line[1], p)


def _train(texts: list[str], labels: np.ndarray, p: ToxicityParams) -> ToxicityModel:
    """Joint training of bucket embeddings and softmax on labelled texts."""
    buckets = 1 << p.bucket_bits
    flat = ToxicityModel(np.zeros(buckets), -30.0 if labels.sum() * 2 < len(labels) or not len(labels) else 30.0, p)
    if len(labels) == 0 or labels.min() == labels.max():
        return flat
    # Words of the sample, once each, with their bags; then documents as bags of words.
    word_rows, word_ids, sub_word, sub_bucket = [], [], [], []
    seen: dict[int, int] = {}
    base = 0
    for at in range(0, len(texts), 64):
        part = texts[at : at + 64]
        bags = SubwordBags(pa.array(part, pa.large_string()), p)
        if len(bags.starts) == 0:
            base += len(part)
            continue
        names = bags.word_names()
        unique, first, inverse = np.unique(names, return_index=True, return_inverse=True)
        ids = np.empty(len(unique), np.int64)
        fresh = np.zeros(len(bags.starts), dtype=bool)
        for k, name in enumerate(unique.tolist()):
            known = seen.get(name)
            if known is None:
                known = seen[name] = len(seen)
                fresh[first[k]] = True
            ids[k] = known
        words = ids[inverse]
        word_rows.append((bags.rows + base).astype(np.int32))
        word_ids.append(words.astype(np.int32))
        base += len(part)
        new = np.flatnonzero(fresh)
        sub_word.append(words[new].astype(np.int32))
        sub_bucket.append(bags.word_buckets()[new].astype(np.int32))
        for n, valid, found in bags.orders():
            length = bags.ends[new] - bags.starts[new]
            counts = np.maximum(length + 3 - n, 0)
            place = np.repeat(bags.starts[new] - 1, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            sub_word.append(np.repeat(words[new].astype(np.int32), counts))
            sub_bucket.append(found[place].astype(np.int32))
    if not seen:
        return flat
    rows, words = np.concatenate(word_rows), np.concatenate(word_ids)
    pairs, times = np.unique(rows.astype(np.int64) * len(seen) + words, return_counts=True)
    rows, words = (pairs // len(seen)).astype(np.int32), (pairs % len(seen)).astype(np.int32)
    del pairs, word_rows, word_ids
    sub_word, sub_bucket = np.concatenate(sub_word), np.concatenate(sub_bucket)
    n_docs, n_words = len(texts), len(seen)
    del seen
    doc_total = np.maximum(np.bincount(rows, weights=times, minlength=n_docs), 1)
    weight = (times / doc_total[rows]).astype(np.float32)
    bag_size = np.maximum(np.bincount(sub_word, minlength=n_words), 1).astype(np.float32)
    # Buckets of few documents would only memorise those documents.
    doc_words = np.bincount(words, minlength=n_words)
    used = np.bincount(sub_bucket, weights=doc_words[sub_word], minlength=buckets) >= p.min_docs
    keep = used[sub_bucket]
    sub_word, sub_bucket = sub_word[keep], sub_bucket[keep]
    live = np.flatnonzero(np.bincount(sub_bucket, minlength=buckets))
    sub_live = np.zeros(buckets, dtype=np.int32)
    sub_live[live] = np.arange(len(live), dtype=np.int32)
    sub_live = sub_live[sub_bucket]
    by_word, word_edges = _csr(sub_word, sub_live, n_words)
    by_bucket, bucket_edges = _csr(sub_live, sub_word, len(live))
    order_d = np.argsort(rows, kind="stable")
    d_words, d_weight, d_edges = words[order_d], weight[order_d][:, None], np.searchsorted(rows[order_d], np.arange(n_docs + 1))
    order_w = np.argsort(words, kind="stable")
    w_docs, w_weight, w_edges = rows[order_w], weight[order_w][:, None], np.searchsorted(words[order_w], np.arange(n_words + 1))
    # Buckets are scaled by the spread of their feature, so that steps follow a bucket's evidence, not its frequency.
    spread = np.bincount(words, weights=weight.astype(np.float64) ** 2, minlength=n_words) / bag_size**2
    spread = np.bincount(sub_live, weights=spread[sub_word], minlength=len(live)) / n_docs
    size = (1 / np.sqrt(spread + np.median(spread) * p.damping)).astype(np.float32)[:, None]
    rng = np.random.default_rng(p.seed)
    params = [
        rng.normal(0, 1e-4, (len(live), p.dim)).astype(np.float32),
        rng.normal(0, 0.5, (p.dim, 2)).astype(np.float32),
        np.log(np.maximum(np.bincount(labels, minlength=2), 1) / n_docs).astype(np.float32),
    ]
    moments = [(np.zeros_like(x), np.float32(0) if k == 0 else np.zeros_like(x)) for k, x in enumerate(params)]
    truth = np.eye(2, dtype=np.float32)[labels]
    for step in range(1, p.rounds + 1):
        table, softmax, bias = params
        vectors = _sum_rows((table * size)[by_word], word_edges) / bag_size[:, None]
        docs = _sum_rows(vectors[d_words] * d_weight, d_edges)
        logits = docs @ softmax + bias
        logits -= logits.max(axis=1, keepdims=True)
        guess = np.exp(logits)
        guess /= guess.sum(axis=1, keepdims=True)
        slope = ((guess - truth) / n_docs).astype(np.float32)
        d_vectors = _sum_rows((slope @ softmax.T)[w_docs] * w_weight, w_edges) / bag_size[:, None]
        grads = [
            _sum_rows(d_vectors[by_bucket], bucket_edges) * size + np.float32(p.decay) * table,
            docs.T @ slope + np.float32(p.decay) * softmax,
            slope.sum(axis=0),
        ]
        rate = np.float32(p.rate * (1 - 0.9 * step / p.rounds))
        for k, (x, g) in enumerate(zip(params, grads, strict=True)):
            m, v = moments[k]
            m += np.float32(0.1) * (g - m)
            second = np.square(g).sum(axis=1).max() if k == 0 else np.square(g)  # one step size for the whole table
            v = v + np.float32(0.05) * (second - v)
            moments[k] = (m, v)
            x -= rate * (m / np.float32(1 - 0.9**step)) / (np.sqrt(v / np.float32(1 - 0.95**step)) + np.float32(1e-12))
    table = np.zeros(buckets)
    table[live] = (params[0] * size) @ (params[1][:, 1] - params[1][:, 0])
    return ToxicityModel(table, params[2][1] - params[2][0], p)


def fit_from(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Fit on a bounded sample of the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) marks.

    Ids are drawn per class by a hash, at most as many as the bound; just their
    texts leave the scan, and a share of them if their bytes exceed theirs.
    Null labels are left out.
    """
    marked = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and _id is not null")
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if not sizes:
        return fit([], np.empty(0), p)
    drawn = None
    for label in sorted(sizes):
        part = marked.where(F.col("toxic") == label).distinct().orderBy(F.xxhash64("_id", F.lit(p.seed)), "_id").limit(p.max_per_class * (2 - label))
        drawn = part if drawn is None else drawn.unionByName(part)
    drawn = materialize(drawn, "toxic-sample")
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = named.join(F.broadcast(drawn), named["doc_id"] == drawn["_id"])  # at most three times max_per_class ids
    rows = rows.select("text", "toxic").dropDuplicates()
    held = {r["toxic"]: r["b"] for r in rows.groupBy("toxic").agg(F.sum(F.octet_length("text")).alias("b")).collect()}
    chance = F.lit(0.0)
    for label, size in held.items():
        chance = F.when(F.col("toxic") == label, F.lit(min(1.0, p.max_bytes / len(held) / max(size or 1, 1)))).otherwise(chance)
    drawn = rows.where(F.pmod(F.xxhash64("text", F.lit(p.seed)), F.lit(1 << 30)) < chance * (1 << 30))
    prior = sizes.get(1, 0) / sum(sizes.values())

    def run(batches):
        known = sorted((int(toxic), text) for batch in batches for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        model = fit([t for _, t in known], np.array([y for y, _ in known]), p, prior)
        yield pa.RecordBatch.from_arrays([pa.array([model.table.tobytes()], pa.binary()), pa.array([model.bias])], names=["model", "bias"])

    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    # The sample is bounded, so one executor fits it; the driver gets one number per bucket.
    found = drawn.repartition(1).mapInArrow(textscan.released(run), "model binary, bias double").collect()
    if not found:
        return fit([], np.empty(0), p)
    return ToxicityModel(np.frombuffer(found[0]["model"], np.float32), found[0]["bias"], p)


def score_texts(docs: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of ``docs``, score and predicted, one row per row.

    Null and wordless texts get the score of an empty bag.
    """
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    sent = spark.sparkContext.broadcast((model.table, model.bias, model.params))  # 2^bucket_bits floats

    def run(batches):
        own = ToxicityModel(*sent.value)
        for batch in batches:
            for part in textscan.slices(batch, "text"):
                score = own.score(part.column(len(keep)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.array(score), pa.array((score >= own.params.threshold).astype(np.int32))],
                    names=[*keep, "score", "predicted"],
                )

    schema = textscan.schema_with(docs, keep, "score double, predicted int")
    return docs.select(*keep, docs["text"].alias("text")).mapInArrow(textscan.released(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Labels of rows with crc32(doc_id) mod 3 = 1 are never read.  A doc_id that
    is null has no label; labels repeated for an id each count, also where they
    differ.  Without labels of both classes all scores are those of the class
    that is there (0 if none).  Very long texts are scored whole, piece by
    piece.  Repeated rows give repeated rows; other columns are ignored
    whatever their names.
    """
    known = labels.select("doc_id", "toxic").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    named = docs.select("doc_id", "text")
    model = fit_from(named, known, p)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out")
    return score_texts(named, model, ["doc_id"]).select("doc_id", held, "score", "predicted")
