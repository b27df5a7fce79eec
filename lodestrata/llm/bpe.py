"""Byte-level BPE encoding and decoding by a tokenization automaton.

The merge list is compiled by successive merge gadgets.  A state stands for the
set of tokens that may follow.  At first one state loops over all bytes.  The
gadget of a merge (u, v) adds arcs labelled uv wherever u and then v could be
read, and sends all u-arcs to a copy of their target that lacks v.  All arcs
with one label lead to the same state, so the automaton is kept as the arrays
``target`` (by token) and ``parent``, ``removed`` (by state): a copy is its
parent without one arc.  Copies made for the same token follow each other;
they are held as one chain with a table of the arcs that they lack.

The automaton accepts exactly one token sequence for each word, the one that
the merges give, and for each beginning of a word as well.  So a word is
encoded in one pass: each place has one state, found from the states of the
places before it by the transition table.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import textscan
from lodestrata.runtime import ship, small_batches

#: Characters outside of the ranges where Python's re module surely has the classes of the pattern below.
_UNLIKE = re.compile(
    "[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe]|[^\x00-՗‐-⁠぀-ヿ㐀-䶿一-鿿가-힣]"
)
#: Fixed value: the pre-splitting pattern of byte-level BPE; first for the re module, which is faster and knows letters and digits by \w and \d.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


_EXACT_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A single blank between other characters; a word may begin with it but none holds it.
_BLANK = re.compile(r"(?<=[^\s\x1c-\x1f\x85])\x20(?=[^\s\x1c-\x1f\x85])")


@functools.cache
def _unassigned() -> re.Pattern[str]:
    """Code points that Python's Unicode tables do not know; newer tables, such as the library's, may class them."""
    known = [unicodedata.category(chr(c)) != "Cn" for c in range(0x110000)]
    ranges, c = [], 0
    while c < len(known):
        if known[c]:
            c += 1
            continue
        first = c
        while c < len(known) and not known[c]:
            c += 1
        ranges.append(f"{re.escape(chr(first))}-{re.escape(chr(c - 1))}")
    return re.compile("[" + "".join(ranges) + "]")


def byte_letters() -> dict[str, int]:
    """The visible letter of each byte in byte-level vocabularies: printable Latin-1 as it is, the others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}


class TokenAutomaton:
    """The compiled merges of a byte-level BPE vocabulary."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int] | None = None):
        self.special = dict(special or {})
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.label = [b""] * size
        for token, number in vocab.items():
            self.label[number] = token
        for text, number in self.special.items():
            self.label[number] = text.encode()
        self.made = np.full(size, -1, dtype=np.int64)  # the merge that made a token; -1 for bytes
        self.left = np.zeros(size, dtype=np.int64)
        self.right = np.zeros(size, dtype=np.int64)
        self.target = [0] * size
        self.parent, self.removed, self.born = [-1], [-1], [-1]
        self.chain = [-1]  # by state
        self.lacks: list[dict[int, int]] = []  # by chain: the state that first lacks an arc
        self.base: list[int] = []  # by chain: the state that its first copy was made of
        self.since: list[int] = []  # by chain: the merge of its first copy
        self.number = {bytes([b]): vocab[bytes([b])] for b in range(256) if bytes([b]) in vocab}
        self._cells: dict[int, bool] = {}
        made, left, right = self.made.tolist(), self.left.tolist(), self.right.tolist()
        self._made, self._left, self._right = made, left, right
        own: dict[int, int] = {}  # the chain of a token
        for at, (first, second) in enumerate(merges):
            u, v, uv = self.number.get(first), self.number.get(second), vocab[first + second]
            if u is None or v is None or made[uv] >= 0 or not self._has_arc(self.target[u], v):
                continue  # earlier merges leave no such pair, so the token is never made
            self.target[uv] = self.target[v]
            state = len(self.parent)
            if u not in own:
                own[u] = len(self.lacks)
                self.lacks.append({})
                self.base.append(self.target[u])
                self.since.append(at)
            self.chain.append(own[u])
            self.lacks[own[u]][v] = state
            self.parent.append(self.target[u])
            self.removed.append(v)
            self.born.append(at)
            self.target[u] = state
            made[uv], left[uv], right[uv] = at, u, v
            self.number[first + second] = uv
        self.made[:], self.left[:], self.right[:] = made, left, right
        self._ending: dict[bytes, list[int]] = {}  # by their last bytes, three at most: lengths of tokens, longest first
        for token in self.number:
            self._ending.setdefault(token[-3:], []).append(len(token))
        for tail, lengths in list(self._ending.items()):
            if len(tail) == 3:
                lengths += [n for n in (1, 2) if tail[-n:] in self.number]
            elif len(tail) == 2 and tail[1:] in self.number:
                lengths.append(1)
            self._ending[tail] = sorted({*lengths}, reverse=True)
        self._cut = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.words = _Words(self)
        self._library = None

    def accepts(self, state: int, token: int) -> bool:
        """Whether a state has an arc with a label: copies ask their parent, later labels ask for their first half."""
        while True:
            if self.removed[state] == token:
                return False
            if state and self.born[state] > self._made[token]:
                state = self.parent[state]
            elif self._made[token] >= 0:
                token = self._left[token]
            else:
                return state == 0 or self.removed[state] != token and self.accepts(self.parent[state], token)

    def _has_arc(self, state: int, token: int) -> bool:
        """accepts(state, token), passing a chain of copies in one step."""
        made, born = self._made, self.born
        limit = 1 << 60
        while state:
            chain = self.chain[state]
            lacking = self.lacks[chain].get(token)
            if lacking is not None and lacking <= state and born[lacking] <= limit:
                return False
            if made[token] >= self.since[chain]:  # copies older than the token are asked for its first half
                limit, token = made[token], self._left[token]
            else:
                state = self.base[chain]
        return True

    def step(self, state: int, token: int) -> bool:
        """Whether a state has an arc, which then leads to ``target[token]``: a cell of the transition table, filled when first read."""
        cell = state << 20 | token
        known = self._cells.get(cell)
        if known is None:
            known = self._has_arc(state, token)
            if len(self._cells) < 2_000_000:
                self._cells[cell] = known
        return known

    def arc(self, x: int, y: int) -> bool:
        """Whether y may follow x."""
        return self.step(self.target[x], y)

    def encode_word(self, word: bytes) -> list[int]:
        """The accepted token path of a word.

        One token with an arc from the state of its beginning ends at each
        place, as the automaton is unambiguous; it gives the place its state.
        """
        number, ending, target, cells, step = self.number, self._ending, self.target, self._cells, self.step
        whole = number.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        state, token_at, from_at = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            lengths = ending.get(word[max(0, end - 3) : end])
            if lengths is None:
                lengths = ending.get(word[max(0, end - 2) : end]) or (1,)
            for length in lengths:
                if length > end:
                    continue
                begin = end - length
                token = number.get(word[begin:end])
                if token is None:
                    continue
                before = state[begin]
                if before:
                    known = cells.get(before << 20 | token)
                    if not (step(before, token) if known is None else known):
                        continue
                state[end], token_at[end], from_at[end] = target[token], token, begin
                break
            else:
                raise ValueError(f"bytes that the vocabulary lacks: {word[:40]!r}")
        path = []
        while n:
            path.append(token_at[n])
            n = from_at[n]
        return path[::-1]

    def split(self, text: str) -> list[str]:
        """Pre-split words; the library's own splitter serves texts with characters that only its Unicode tables may know."""
        if not _UNLIKE.search(text):
            return _PIECES.findall(text)
        if not _unassigned().search(text):
            return _EXACT_PIECES.findall(text)
        if self._library is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self._library = ByteLevel(add_prefix_space=False, use_regex=True)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def encode(self, text: str) -> bytes:
        """Token numbers as little-endian unsigned 32-bit integers."""
        if self._cut is None or not self._cut.search(text):
            return self._plain(text)
        out, at = [], 0
        for found in self._cut.finditer(text):
            out.append(self._plain(text[at : found.start()]))
            out.append(self.special[found.group()].to_bytes(4, "little"))
            at = found.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str, piece: int = 1 << 18) -> bytes:
        """Tokens of a text without special tokens; long ones in pieces, cut at single blanks, where every split cuts."""
        words = self.words
        if len(text) <= 2 * piece:
            return b"".join([words[w] for w in self.split(text)])
        out, at = [], 0
        while at < len(text):
            found = _BLANK.search(text, at + piece)
            to = found.start() if found else len(text)
            out.append(b"".join([words[w] for w in self.split(text[at:to])]))
            at = to
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The labels along a token path, as text; broken UTF-8 becomes U+FFFD."""
        label = self.label
        return b"".join([label[i] for i in ids.tolist()]).decode("utf-8", "replace")


class _Words(dict):
    """Encoded words; up to ``limit`` are kept, those met first, which are the frequent ones."""

    def __init__(self, automaton: TokenAutomaton, limit: int = 250_000):
        super().__init__()
        self.automaton, self.limit = automaton, limit

    def __missing__(self, word: str) -> bytes:
        found = np.array(self.automaton.encode_word(word.encode()), dtype="<u4").tobytes()
        if len(self) < self.limit and len(word) < 64:
            self[word] = found
        return found


def compile_tokenizer(content: bytes) -> TokenAutomaton:
    """The automaton of a byte-level BPE file in the JSON format of the tokenizers library.

    Files with settings that the automaton does not follow raise ValueError.
    """
    data = json.loads(content)
    model, splitter = data["model"], data.get("pre_tokenizer") or {}
    wrong = [name for name in ("ignore_merges", "byte_fallback", "fuse_unk", "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(name)]
    wrong += ["normalizer"] if data.get("normalizer") else []
    wrong += ["pre_tokenizer"] if splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True) else []
    wrong += ["decoder"] if (data.get("decoder") or {}).get("type") != "ByteLevel" else []
    flags = ("single_word", "lstrip", "rstrip")
    wrong += [f"added token {t['content']!r}" for t in data.get("added_tokens", []) if not t["content"] or any(t.get(flag) for flag in flags)]
    if wrong or model.get("type", "BPE") != "BPE":
        raise ValueError(f"settings that are not supported: {', '.join(wrong) or model.get('type')}")
    letters = byte_letters()
    raw = lambda token: bytes([letters[c] for c in token])
    special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
    vocab = {raw(t): i for t, i in model["vocab"].items() if t not in special}
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    return TokenAutomaton(vocab, [(raw(a), raw(b)) for a, b in merges], special)


_COMPILED: dict[bytes, TokenAutomaton] = textscan.CACHES.setdefault("bpe", {})


def compiled(content: bytes) -> TokenAutomaton:
    """One automaton per process and vocabulary."""
    key = hashlib.sha256(content).digest()
    if key not in _COMPILED:
        _COMPILED[key] = compile_tokenizer(content)
    return _COMPILED[key]


@dataclass(frozen=True)
class BpeParams:
    """``path``: the vocabulary file on the driver; its few megabytes are broadcast."""

    path: str
    max_vocabulary_bytes: int = 64_000_000


def _vocabulary(spark: SparkSession, p: BpeParams):
    with open(p.path, "rb") as source:
        content = source.read(p.max_vocabulary_bytes + 1)
    if len(content) > p.max_vocabulary_bytes:
        raise ValueError("the vocabulary file is larger than the bound on what is broadcast")
    return spark.sparkContext.broadcast(content)


def encode_documents(docs: DataFrame, p: BpeParams, keep: list[str]) -> DataFrame:
    """The ``keep`` columns, n_tokens and token_ids (array<int>) of each row; a null text is empty."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    sent = _vocabulary(spark, p)

    def run(batches):
        automaton = compiled(sent.value)
        for batch in batches:
            for part in textscan.slices(batch, "text"):
                ids = [automaton.encode(t or "") for t in part.column(len(keep)).to_pylist()]
                sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.array(sizes), pa.ListArray.from_arrays(offsets, flat)], names=[*keep, "n_tokens", "token_ids"]
                )

    schema = textscan.schema_with(docs, keep, "n_tokens long, token_ids array<int>")
    return docs.select(*keep, docs["text"].alias("text")).mapInArrow(textscan.released(run, "bpe"), schema)


def decode_documents(tokens: DataFrame, p: BpeParams, keep: list[str], column: str = "token_ids") -> DataFrame:
    """The ``keep`` columns and the text of each row's token numbers; null stays null."""
    spark = tokens.sparkSession
    ship(spark)
    small_batches(spark)
    sent = _vocabulary(spark, p)

    def run(batches):
        automaton = compiled(sent.value)
        for batch in batches:
            ids = batch.column(len(keep)).to_pylist()
            texts = [None if x is None else automaton.decode(np.array(x, dtype=np.int64)) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "text"])

    schema = textscan.schema_with(tokens, keep, "text string")
    return tokens.select(*keep, tokens[column].alias(column)).mapInArrow(textscan.released(run, "bpe"), schema)


def token_digests(docs: DataFrame, p: BpeParams) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: encoded, then decoded again.

    A null or empty text has no tokens.  Very long texts are read whole, piece
    by piece.  Repeated rows give repeated rows; other columns are ignored
    whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    sent = _vocabulary(spark, p)

    def run(batches):
        automaton = compiled(sent.value)
        sha = hashlib.sha256
        for batch in batches:
            for part in textscan.slices(batch, "text"):
                counts, encoded, decoded = [], [], []
                for text in part.column(1).to_pylist():
                    ids = automaton.encode(text or "")
                    counts.append(len(ids) // 4)
                    encoded.append(sha(ids).hexdigest())
                    decoded.append(sha(automaton.decode(np.frombuffer(ids, "<u4")).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = textscan.schema_with(docs, ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select("doc_id", "text").mapInArrow(textscan.released(run, "bpe"), schema)
