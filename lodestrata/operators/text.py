"""Full-text operators as DataFrame compositions."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lodestrata.runtime import materialize, ship

#: Words that the BM25 tokenizer drops.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on or that the this to was were will with you your i".split()
)


def filter_tokens(text: str) -> list[str]:
    """Words of a filter: letters and digits, lower-cased, each once."""
    return list(dict.fromkeys(re.findall(r"[^\W_]+", text.lower())))


def words_of(column: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


def bm25_tokens(column: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    return F.filter(found, lambda w: ~w.isin(STOP_WORDS))


_TOKENS = re.compile(r"\w+")


def _counted(text: str | None) -> tuple[Counter[str], int]:
    """BM25 tokens with their counts, stop words among them, and the number without those."""
    found = _TOKENS.findall((text or "").lower())
    counts = Counter(found)
    return counts, len(found) - sum(counts[w] for w in STOP_WORDS)


def _query_terms(query: str) -> list[str]:
    return [w for w in dict.fromkeys(_TOKENS.findall(query.lower())) if w not in STOP_WORDS]


def bm25(docs: DataFrame, query: str, id_column: str = "id", text_column: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of documents with a query word, by Okapi BM25 over the whole corpus.

    Texts are read once, in Arrow batches: their lengths and the query's term
    counts are written as a narrow table, from which come both the corpus
    statistics (one row) and the scores, without a shuffle.  For many searches
    of one corpus see ``Bm25Index``.
    """
    terms = _query_terms(query)
    named = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            counted = [_counted(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([n for _, n in counted], pa.int32()), *(pa.array([c[t] for c, _ in counted], pa.int32()) for t in terms)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "dl", *(f"tf{i}" for i in range(len(terms)))])

    schema = StructType([named.schema["id"], *(StructField(n, IntegerType()) for n in ["dl", *(f"tf{i}" for i in range(len(terms)))])])
    per_doc = materialize(named.mapInArrow(run, schema), "bm25")
    stats = per_doc.agg(
        F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(terms))]
    )
    score: Column = F.lit(0.0)
    for i in range(len(terms)):
        score = score + _okapi(F.col(f"tf{i}"), F.col("dl"), F.col(f"df{i}"), F.col("n"), F.col("avgdl"), k1, b)
    any_term = reduce(Column.__or__, [F.col(f"tf{i}") > 0 for i in range(len(terms))], F.lit(False))
    return per_doc.where(any_term).crossJoin(F.broadcast(stats)).select("id", score.alias("score"))  # stats is one row


def _okapi(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column, k1: float, b: float) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.greatest(avgdl, F.lit(1.0))))


class Bm25Index:
    """Postings (term, id, tf, dl) in order of term, and one row of statistics; a search reads the files of its terms only."""

    def __init__(self, docs: DataFrame, id_column: str = "id", text_column: str = "text"):
        named = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
        ship(docs.sparkSession)

        def run(batches):
            for batch in batches:
                at, terms, tf, dl = [], [], [], []
                for row, text in enumerate(batch.column(1).to_pylist()):
                    counts, n = _counted(text)
                    for w in STOP_WORDS:
                        del counts[w]
                    # A document without tokens is kept as one posting of the empty term, for the statistics.
                    own = counts or {"": 0}
                    at += [row] * len(own)
                    terms += own.keys()
                    tf += own.values()
                    dl += [n] * len(own)
                columns = [pa.array(terms, pa.string()), batch.column(0).take(pa.array(at, pa.int64())), pa.array(tf, pa.int32()), pa.array(dl, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["term", "id", "tf", "dl"])

        schema = StructType([StructField("term", StringType()), named.schema["id"], StructField("tf", IntegerType()), StructField("dl", IntegerType())])
        postings = named.mapInArrow(run, schema)
        # A frequent term spreads over several ranges, as the id takes part in the order.
        self.postings = materialize(postings.repartitionByRange("term", "id").sortWithinPartitions("term"), "bm25-postings")
        lengths = self.postings.groupBy("id").agg(F.first("dl").alias("dl"))
        self.stats = materialize(lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")), "bm25-stats")

    def search(self, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(id, score) of documents with a query word; ids name documents."""
        terms = _query_terms(query)
        found = self.postings.where(F.col("term").isin(terms) if terms else F.lit(False))
        frequency = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # one row for each query word
        joined = found.join(F.broadcast(frequency), "term").crossJoin(F.broadcast(self.stats))
        score = _okapi(F.col("tf"), F.col("dl"), F.col("df"), F.col("n"), F.col("avgdl"), k1, b)
        return joined.groupBy("id").agg(F.sum(score).alias("score"))


def phrase_search(docs: DataFrame, phrase: str, boosts: dict[str, float], id_column: str = "id") -> DataFrame:
    """(id, score): sum of the boosts of the fields that contain the phrase, whatever its case."""
    score: Column = F.lit(0.0)
    for name, boost in boosts.items():
        score = score + F.when(F.contains(F.lower(name), F.lit(phrase.lower())), F.lit(boost)).otherwise(F.lit(0.0))
    return docs.select(F.col(id_column).alias("id"), score.alias("score")).where("score > 0")


def fielded_bm25(docs: DataFrame, query: str, boosts: dict[str, float], id_column: str = "id") -> DataFrame:
    """(id, score): BM25 per field, weighted by the field's boost and summed."""
    parts = [bm25(docs, query, id_column, name).select("id", (F.col("score") * boost).alias("score")) for name, boost in boosts.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("score").alias("score"))


def prefix_search(docs: DataFrame, prefix: str, id_column: str = "id", text_column: str = "text") -> DataFrame:
    """Documents with a word that starts with the prefix."""
    return docs.where(F.exists(words_of(F.col(text_column)), lambda w: w.startswith(prefix.lower()))).select(F.col(id_column).alias("id"))


def fuzzy_search(docs: DataFrame, term: str, distance: int, id_column: str = "id", text_column: str = "text") -> DataFrame:
    """(id, best): documents with a word within an edit distance; lengths are compared first."""
    near = F.filter(
        words_of(F.col(text_column)),
        lambda w: (F.abs(F.length(w) - len(term)) <= distance) & (F.levenshtein(w, F.lit(term), distance) >= 0),
    )
    found = docs.select(F.col(id_column).alias("id"), F.array_distinct(near).alias("near")).where(F.size("near") > 0)
    return found.select("id", F.array_min(F.transform("near", lambda w: F.levenshtein(w, F.lit(term)))).alias("best"))


def snippet(column: Column, term: str, around: int = 40) -> Column:
    """Text around the first hit of a term; null without one."""
    at = F.instr(F.lower(column), term.lower())
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substring(column, start, at - start + len(term) + around))


def passages(docs: DataFrame, id_column: str = "id", text_column: str = "text", min_chars: int = 24, min_words: int = 4) -> DataFrame:
    """(id, passage, body): lines with enough characters and words."""
    lines = docs.select(F.col(id_column).alias("id"), F.posexplode(F.split(F.coalesce(text_column, F.lit("")), "\n")).alias("passage", "line"))
    body = F.trim("line")
    return lines.where((F.length(body) >= min_chars) & (F.size(words_of(F.col("line"))) >= min_words)).select("id", "passage", body.alias("body"))


def _is(term: str):
    return lambda word: word == term


def passage_scores(found: DataFrame, query: str) -> DataFrame:
    """Passages scored by saturated term counts, coverage of the query and length."""
    terms = filter_tokens(query)
    words = words_of(F.col("body"))
    scored = found.withColumn("w", words)
    total, matched = F.lit(0.0), F.lit(0)
    for t in terms:
        tf = F.size(F.filter("w", _is(t)))
        total = total + tf / (tf + F.lit(1.2))
        matched = matched + (tf > 0).cast("int")
    score = total * (matched / F.lit(float(max(1, len(terms))))) * (1 / (1 + F.size("w") / F.lit(240.0)))
    return scored.select("id", "passage", "body", score.alias("score")).where("score > 0")


def excerpt(scored: DataFrame, budget: int, id_column: str = "id") -> DataFrame:
    """Best passages of each document while their characters fit a budget; the first always does."""
    order = Window.partitionBy(id_column).orderBy(F.col("score").desc(), "passage")
    running = F.sum(F.length("body")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranked = scored.withColumn("rank", F.row_number().over(order)).withColumn("chars", running)
    return ranked.where((F.col("rank") == 1) | (F.col("chars") <= budget))


def code_terms(column: Column) -> Column:
    """Sorted distinct parts of paths and symbols: split at punctuation and at changes of case."""
    spaced = F.regexp_replace(column, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(spaced), r"[^\p{L}\p{N}]+"), lambda w: w != "")))
