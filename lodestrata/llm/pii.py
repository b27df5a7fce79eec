"""Personal data by weak supervision.

Base patterns find e-mail addresses, IP addresses, card and telephone numbers.
Wider candidate patterns find spans that may be personal data in other forms:
secrets, account numbers, local telephone numbers, masked addresses, IBANs,
identity numbers, dates of birth, names of persons and postal addresses.
Regex, gazetteer and context labelers vote on every candidate;
expectation-maximisation estimates each labeler's reliability from the vote
counts of the whole corpus and gives each vote pattern a probability; a final
logistic span classifier is trained on those, and spans that it accepts are
added to the base ones.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import textscan
from lodestrata.runtime import ship, small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret", "account", "local_phone", "masked_email", "iban", "national_id", "birth_date", "person", "address")
KINDS = BASE_KINDS + ADDED_KINDS

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_SPACED_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """The check-digit rule of card numbers."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (2 if place % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # An address is looked for at each "@", so that long runs of letters are read once.
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            floor = found.end()
        at = text.find("@", found.end() if found else at + 1)


def _phones(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("+")
    while at >= 0:
        found = _PHONE.match(text, at)
        if found and 8 <= sum(c in "0123456789" for c in found.group()) <= 15:
            yield at, found.end()
        at = text.find("+", found.end() if found else at + 1)


def base_spans(text: str) -> list[Span]:
    """Base spans by kind, then start; leftmost and non-overlapping within a kind."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for run in _DOTTED.finditer(text):
            if run.group().count(".") >= 3:
                for m in _QUAD.finditer(run.group()):
                    if all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in m.group().split(".")):
                        out.append(("ip", run.start() + m.start(), run.start() + m.end()))
        for m in _SPACED_DIGITS.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        out += [("phone", a, b) for a, b in _phones(text)]
    return out


#: Words that announce personal data, in four languages.
_CUES = {
    "secret": ("token", "key", "secret", "password", "passwd", "apikey", "bearer", "credential", "contraseña", "passwort", "clave", "schlüssel"),
    "account": ("card", "account", "visa", "mastercard", "konto", "karte", "carte", "compte", "cuenta", "tarjeta"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "handy", "téléphone", "teléfono", "móvil"),
    "masked_email": ("mail", "email", "e-mail", "contact", "write", "kontakt", "correo", "courriel"),
    "iban": ("iban", "account", "transfer", "konto", "überweisung", "compte", "virement", "cuenta", "transferencia"),
    "national_id": ("ssn", "social security", "identity", "passport", "ausweis", "pasaporte", "passeport", "dni"),
    "birth_date": ("born", "birth", "dob", "birthday", "geboren", "geburtsdatum", "né le", "née le", "naissance", "nacido", "nacida", "nacimiento"),
    "person": ("name", "named", "called", "signed", "author", "heißt", "unterzeichnet", "nommé", "nommée", "llamado", "llamada", "nombre"),
    "address": ("address", "lives at", "resides at", "ship to", "adresse", "wohnt", "anschrift", "habite", "domicile", "dirección", "vive en"),
}
#: Words before numbers and strings that are no personal data.
_OTHERWISE = (
    "order", "invoice", "isbn", "issn", "page", "version", "build", "commit", "revision", "sha", "sha1", "sha256", "md5", "hash", "checksum",
    "serial", "tracking", "bestellung", "rechnung", "seite", "commande", "facture", "pedido", "factura",
)
_CUE_OF = {kind: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, words)) + r")(?!\w)", re.I) for kind, words in _CUES.items()}
_OTHERWISE_BEFORE = re.compile(r"(?<!\w)(?:" + "|".join(_OTHERWISE) + r")(?!\w)", re.I)
#: Leading digits of card issuers, and beginnings of well-known tokens.
_ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "60", "62", "65")
_TOKENS = ("sk_", "pk_", "rk_", "ghp_", "gho_", "ghs_", "github_pat_", "AKIA", "ASIA", "AIza", "eyJ", "xox", "npm_", "hf_")
#: Endings of mail domains, and countries of IBANs.
_ENDINGS = frozenset("com org net edu gov io co info biz de fr es it nl at ch be pt pl uk us eu ca au jp cn ru br mx ar".split())
_IBAN_COUNTRIES = frozenset("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK TR".split())
#: Frequent given names of four languages, and titles.
_GIVEN = frozenset(
    """James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Kenneth George Kevin
    Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Lisa Betty Dorothy Sandra Ashley Emily Emma Olivia
    Hans Peter Klaus Jürgen Wolfgang Stefan Andreas Uwe Ursula Monika Petra Sabine Renate Helga Karin Anna Lena Jean Pierre Michel Philippe Alain
    Jacques François Nicolas Marie Nathalie Isabelle Sylvie Catherine Françoise Camille Chloé José Antonio Juan Manuel Francisco Luis Javier
    Carlos Miguel Pedro Pablo María Maria Carmen Josefa Isabel Dolores Pilar Teresa Ana Lucía Elena""".split()
)
_TITLES = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señor|Señora|Sr|Sra|Don|Doña)"

_NAME = r"[A-ZÀ-ÖØ-Þ][^\W\d_]+"
_SECRET = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9_]{20,}+")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_MASK = re.compile(r" ?[\[(](?:at|AT)[\])] ?")
_MASKED_HOST = re.compile(r"[A-Za-z0-9-]++(?:(?: ?[\[(](?:dot|DOT)[\])] ?|\.)[A-Za-z0-9-]++)++")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DATE = re.compile(r"(?<![0-9./-])(?:[0-9]{1,2}([./-])[0-9]{1,2}\1[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9/-])")
_PERSON = re.compile(rf"(?<!\w)(?:{_TITLES}\.? {_NAME}(?: {_NAME})?|{_NAME} {_NAME})(?!\w)")
_TITLE = re.compile(rf"{_TITLES}\.? ")
_ADDRESS = re.compile(
    rf"(?<!\w)(?:[0-9]{{1,5}} {_NAME}(?: {_NAME})? (?:Street|Avenue|Road|Lane|Drive|Boulevard|Square|St|Ave|Rd|Ln|Dr|Blvd)"
    rf"|[A-ZÄÖÜ][^\W\d_]*(?:straße|strasse|weg|platz|gasse) [0-9]{{1,4}}[a-z]?"
    rf"|[0-9]{{1,4}},? (?:rue|avenue|boulevard|place|allée) (?:(?:de|du|des|la|le|les) )*{_NAME}"
    rf"|(?:Calle|Avenida|Plaza|Paseo) (?:(?:de|del|la|las|los|el) )*{_NAME},? [0-9]{{1,4}})(?!\w)"
)
_SHORT_STREET = re.compile(r" (?:St|Ave|Rd|Ln|Dr|Blvd)$")


def _masked_emails(text: str) -> Iterator[tuple[int, int]]:
    # As with addresses, each mask is looked at once, so that long runs of letters are read once.
    floor = 0
    for mask in _MASK.finditer(text):
        start = mask.start()
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        host = _MASKED_HOST.match(text, mask.end()) if start < mask.start() else None
        if host:
            yield start, host.end()
            floor = host.end()


def _persons(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while found := _PERSON.search(text, at):
        titled = _TITLE.match(found.group())
        first, _, rest = found.group().partition(" ")
        if titled or first in _GIVEN:
            yield found.span()
            at = found.end()
        else:  # the second word may begin a name
            at = found.start() + len(first) + 1


def _matches(pattern: re.Pattern[str]):
    def find(text: str) -> Iterator[tuple[int, int]]:
        return (m.span() for m in pattern.finditer(text))

    return find


_CANDIDATES = {
    "secret": _matches(_SECRET),
    "account": _matches(_SPACED_DIGITS),
    "local_phone": _matches(_LOCAL_PHONE),
    "masked_email": _masked_emails,
    "iban": _matches(_IBAN),
    "national_id": _matches(_NATIONAL),
    "birth_date": _matches(_DATE),
    "person": _persons,
    "address": _matches(_ADDRESS),
}
#: Kinds whose spans all hold a digit.
_WITH_DIGIT = frozenset(ADDED_KINDS) - {"masked_email", "person"}

LABELERS = ("shape", "gazetteer", "cue before", "assignment before", "stands alone")
#: By labeler, for votes -1, 0 and 1: their rates on personal data and on other candidates before any data are seen.
_PRIOR_RATES = np.array(
    [
        [[0.05, 0.25, 0.70], [0.60, 0.30, 0.10]],
        [[0.10, 0.50, 0.40], [0.30, 0.55, 0.15]],
        [[0.02, 0.48, 0.50], [0.13, 0.80, 0.07]],
        [[0.05, 0.55, 0.40], [0.20, 0.75, 0.05]],
        [[0.10, 0.05, 0.85], [0.40, 0.05, 0.55]],
    ]
)
#: What those rates, and a share of 0.3 of personal data, weigh: as much as this number of candidates, whatever the corpus.
_PRIOR_WEIGHT = 20.0
_PRIOR_SHARE = 0.3


@dataclass(frozen=True)
class Candidate:
    kind: str
    start: int
    end: int
    votes: tuple[int, ...]
    features: tuple[int, ...]


def _iban_rest(plain: str) -> int:
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def _form(kind: str, found: str, plain: str, digits: int) -> tuple[int, int]:
    """The votes of the labelers that look at the span alone: shape and gazetteer."""
    if kind == "secret":
        shape = 1 if re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}|[0-9A-Z]{20}", found) else -1 if digits * 8 < len(found) else 0
        return shape, 1 if found.startswith(_TOKENS) else 0
    if kind == "account":
        shape = 1 if luhn(plain) and len(plain) in (13, 14, 15) else -1 if len(plain) >= 13 else 0
        return shape, 1 if plain.startswith(_ISSUERS) else -1 if plain.startswith("0") else 0
    if kind == "local_phone":
        number = re.sub("[^0-9]", "", found)
        shape = 1 if number[0] not in "01" and number[3] not in "01" else -1
        return shape, -1 if number[1:3] == "11" or number[3:6] == "555" and number[6:8] == "01" else 1 if found.startswith("(") else 0
    if kind == "masked_email":
        return 1 if re.search(r"[\[(](?:dot|DOT)[\])]", found) else 0, 1 if re.split(r"[^A-Za-z0-9]+", found)[-1].lower() in _ENDINGS else -1
    if kind == "iban":
        return 1 if _iban_rest(plain) == 1 else -1, 1 if plain[:2] in _IBAN_COUNTRIES else -1
    if kind == "national_id":
        good = found[:3] not in ("000", "666") and found[0] != "9" and found[4:6] != "00" and found[7:] != "0000"
        return 1 if good else -1, -1 if found in ("078-05-1120", "219-09-9999", "123-45-6789") else 0
    if kind == "birth_date":
        parts = [int(x) for x in re.split("[./-]", found)]
        year, (a, b) = (parts[0], parts[1:]) if parts[0] > 31 else (parts[2], parts[:2])
        return 1 if 1 <= min(a, b) <= 12 and max(a, b) <= 31 else -1, 1 if 1900 <= year <= 2020 else -1
    if kind == "person":
        name = _TITLE.sub("", found, count=1)
        return 1 if " " in name else 0, 1 if name.split(" ")[0] in _GIVEN else 0
    return 1, 0 if _SHORT_STREET.search(found) else 1


def _candidate(kind: str, text: str, start: int, end: int) -> Candidate | None:
    found = text[start:end]
    digits = sum(c.isdigit() for c in found)
    if kind == "secret" and (not digits or not any(c.isalpha() for c in found)):
        return None
    plain = found.replace(" ", "").replace("-", "")
    if kind == "account" and not 12 <= len(plain) <= 19:
        return None
    before, after = text[max(0, start - 24) : start], text[end : end + 2]
    shape, known = _form(kind, found, plain, digits)
    announced = _CUE_OF[kind].search(before) or kind == "person" and _TITLE.match(found)
    if kind == "birth_date" and not announced:  # any other date
        return None
    cue = 1 if announced else -1 if _OTHERWISE_BEFORE.search(before) else 0
    assigned = 1 if re.search(r"[:=]\s*[\"']?$", before) else -1 if before[-1:].isalnum() else 0
    alone = 1 if (not before or before[-1] in " \n\t\"'(|") and (not after or after[0] in " \n\t\"').,;|") else -1
    bucket = min(len(plain) // 8, 7)
    features = (bucket, min(7, 8 * digits // max(1, len(plain))), int(before[-1:] in "\"'"), cue + 1, int(assigned > 0), int(alone > 0), shape + 1, known + 1)
    return Candidate(kind, start, end, (shape, known, cue, assigned, alone), features)


def candidates(text: str, base: list[Span]) -> list[Candidate]:
    """Spans outside the base ones that may be personal data, with votes and features."""
    out = []
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in base):  # merged, so that both lists ascend
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    has_digit = _DIGIT.search(text) is not None
    for kind, find in _CANDIDATES.items():
        if not has_digit and kind in _WITH_DIGIT:
            continue
        for a, b in find(text):
            at = bisect_right(ends, a)  # the first base span that ends behind the start
            if at < len(starts) and starts[at] < b:
                continue
            found = _candidate(kind, text, a, b)
            if found:
                out.append(found)
    return out


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Probability of each vote pattern by expectation-maximisation over labeler reliabilities.

    A labeler votes 1, -1 or abstains (0).  Every labeler has rates of its
    votes on either class; they start at ``_PRIOR_RATES``, which weigh as much
    as ``_PRIOR_WEIGHT`` candidates, so in a large corpus the votes decide.
    """
    if len(votes) == 0:
        return np.empty(0)
    rates = np.log(_PRIOR_RATES[: votes.shape[1]])
    share = _PRIOR_SHARE
    belief = np.empty(0)
    for _ in range(rounds):
        yes, no = np.full(len(votes), np.log(share)), np.full(len(votes), np.log(1 - share))
        for labeler in range(votes.shape[1]):
            yes += rates[labeler, 0, votes[:, labeler] + 1]
            no += rates[labeler, 1, votes[:, labeler] + 1]
        last, belief = belief, 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))
        if len(last) and np.abs(last - belief).max() < 1e-9:
            break
        share = (belief @ counts + _PRIOR_SHARE * _PRIOR_WEIGHT) / (counts.sum() + _PRIOR_WEIGHT)
        for side, weight in enumerate((belief * counts, (1 - belief) * counts)):
            for labeler in range(votes.shape[1]):
                cast = np.bincount(votes[:, labeler] + 1, weights=weight, minlength=3)
                rates[labeler, side] = np.log((cast + _PRIOR_WEIGHT * _PRIOR_RATES[labeler, side]) / (weight.sum() + _PRIOR_WEIGHT))
    return belief


def _design(kinds: list[str], features: np.ndarray) -> np.ndarray:
    sizes = (8, 9, 2, 3, 2, 2, 3, 3)
    columns = [np.array([[k == kind for kind in ADDED_KINDS] for k in kinds], dtype=float)]
    columns += [np.eye(size)[np.clip(features[:, at], 0, size - 1)] for at, size in enumerate(sizes)]
    return np.concatenate(columns, axis=1)


class SpanClassifier:
    """A logistic classifier of candidates, trained on estimated probabilities."""

    def __init__(self, weights: np.ndarray, threshold: float):
        self.weights, self.threshold = weights, threshold
        self._seen: dict[tuple, bool] = {}

    def accepts(self, c: Candidate) -> bool:
        key = (c.kind, c.features)
        if key not in self._seen:
            logit = float((_design([c.kind], np.array([c.features])) @ self.weights)[0])
            self._seen[key] = logit > np.log(self.threshold / (1 - self.threshold))
        return self._seen[key]


def train(patterns: list[tuple[str, tuple[int, ...], tuple[int, ...], int]], threshold: float = 0.5) -> SpanClassifier:
    """Fit on (kind, votes, features, count) of all candidates of a corpus."""
    patterns = sorted(patterns)
    weights = np.zeros(len(ADDED_KINDS) + 32)
    if not patterns:
        weights[: len(ADDED_KINDS)] = -1.0
        return SpanClassifier(weights, threshold)
    kinds = [k for k, *_ in patterns]
    votes, features = np.array([v for _, v, _, _ in patterns]), np.array([f for _, _, f, _ in patterns])
    counts = np.array([n for *_, n in patterns], dtype=float)
    truth = np.zeros(len(patterns))
    for kind in ADDED_KINDS:
        own = np.array([k == kind for k in kinds])
        truth[own] = estimate(votes[own], counts[own])
    design = _design(kinds, features)
    weight = counts / counts.sum()
    for _ in range(25):  # ridged Newton steps
        guess = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (weight * (guess - truth)) + 1e-4 * weights
        curve = (design * (weight * guess * (1 - guess))[:, None]).T @ design + 1e-4 * np.eye(len(weights))
        weights = weights - np.clip(np.linalg.solve(curve, slope), -2, 2)
    return SpanClassifier(weights, threshold)


def all_spans(text: str, classifier: SpanClassifier) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by kind, then start."""
    base = base_spans(text)
    added = [(c.kind, c.start, c.end) for c in candidates(text, base) if classifier.accepts(c)]
    added.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return base, base + added


def fit_classifier(docs: DataFrame, threshold: float = 0.5) -> SpanClassifier:
    """Count vote and feature patterns over all documents, then estimate and train on the driver.

    A pattern is a few small numbers, so their count is bounded whatever the corpus.
    """
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)

    def run(batches):
        seen: dict[tuple, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    for c in candidates(text, base_spans(text)):
                        key = (c.kind, c.votes, c.features)
                        seen[key] = seen.get(key, 0) + 1
        kinds, votes, features = zip(*seen, strict=True) if seen else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(kinds, pa.string()),
                pa.array(votes, pa.list_(pa.int32())),
                pa.array(features, pa.list_(pa.int32())),
                pa.array(list(seen.values()), pa.int64()),
            ],
            names=["kind", "votes", "features", "n"],
        )

    counted = docs.select("text").mapInArrow(textscan.released(run), "kind string, votes array<int>, features array<int>, n long")
    rows = counted.groupBy("kind", "votes", "features").agg(F.sum("n").alias("n")).collect()
    return train([(r["kind"], tuple(r["votes"]), tuple(r["features"]), r["n"]) for r in rows], threshold)


def _join(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, classifier: SpanClassifier | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each row of ``docs``.

    A null or empty text has no spans.  Very long texts are read whole, in time
    linear in their length.  Repeated rows give repeated rows; other columns
    are ignored whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    own = fit_classifier(docs) if classifier is None else classifier

    def run(batches):
        for batch in batches:
            counts: list[list[int]] = [[] for _ in BASE_KINDS]
            digests, spans = [], []
            for text in batch.column(1).to_pylist():
                base, found = all_spans(text or "", own)
                for at, kind in enumerate(BASE_KINDS):
                    counts[at].append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(_join(base).encode()).hexdigest())
                spans.append(_join(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"],
            )

    added = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(textscan.released(run), textscan.schema_with(docs, ["doc_id"], added))


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one, named by the first."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join(out) + text[at:]


def redact_documents(docs: DataFrame, classifier: SpanClassifier | None = None) -> DataFrame:
    """``docs`` with personal data replaced in text (and n_chars, where it is there, counted anew)."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    own = fit_classifier(docs) if classifier is None else classifier
    names = list(docs.columns)
    place = names.index("text")

    def run(batches):
        for batch in batches:
            texts = [t and redact(t, all_spans(t, own)[1]) for t in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.mapInArrow(textscan.released(run), docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*names)
    return out
