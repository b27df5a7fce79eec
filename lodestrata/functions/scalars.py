"""Scalar functions as column expressions on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORDS = r"[^\p{L}\p{N}]+"


def _parts(c: Column) -> Column:
    """Words of an identifier: split at punctuation, and before a capital that follows a small letter or digit."""
    spaced = F.regexp_replace(c, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    return F.filter(F.split(F.lower(spaced), _WORDS), lambda w: w != "")


def _cap(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))


def lower(c: Column) -> Column:
    return F.lower(c)


def upper(c: Column) -> Column:
    return F.upper(c)


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1_000_000)))


def pascal(c: Column) -> Column:
    return F.array_join(F.transform(_parts(c), _cap), "")


def camel(c: Column) -> Column:
    p = pascal(c)
    return F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))


def kebab(c: Column) -> Column:
    return F.array_join(_parts(c), "-")


def snake(c: Column) -> Column:
    return F.array_join(_parts(c), "_")


def uncamel(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2"))


#: Fixed value: words that stay in lower case inside a title.
SMALL_WORDS = "a an and as at but by for in nor of on or so the to up yet".split()


def title(c: Column) -> Column:
    """Each word capitalised but for small words after the first."""
    words = F.split(F.lower(c), " ")
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(SMALL_WORDS), w).otherwise(_cap(w))), " ")


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def reverse(c: Column) -> Column:
    return F.reverse(c)


def length(c: Column) -> Column:
    return F.length(c)


def split(c: Column, by: str) -> Column:
    return F.split(c, "(?s)" + "\\Q" + by + "\\E") if by else F.split(c, "")


def join(c: Column, by: str) -> Column:
    return F.array_join(c, by)


def first(c: Column) -> Column:
    return F.try_element_at(c, F.lit(1))


def last(c: Column) -> Column:
    return F.try_element_at(c, F.lit(-1))


def nth(c: Column, step: int, offset: int) -> Column:
    """Elements offset, offset + step, ... counted from 1."""
    return F.filter(c, lambda x, i: ((i + 1) >= offset) & (F.pmod(i + 1 - offset, F.lit(step)) == 0))


def slice_text(c: Column, start: int, end: int | None = None) -> Column:
    """Substring [start, end); negative places count from the end."""
    n = F.length(c)
    a = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    b = n if end is None else F.lit(end) if end >= 0 else F.greatest(n + end, F.lit(0))
    return F.substring(c, a + 1, F.greatest(b - a, F.lit(0)))


def unique(c: Column) -> Column:
    return F.array_distinct(c)


def round_half_up(c: Column, places: int) -> Column:
    return F.round(c, places)


def number_format(c: Column, places: int) -> Column:
    return F.format_number(c, places)


def replace(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def safe_name(c: Column) -> Column:
    """A file name: characters that file systems refuse are dropped, dots at the ends too, at most 245 characters."""
    bare = F.regexp_replace(c, r"[<>:\"/\\|?*\x00-\x1F#^\[\]]", "")
    bare = F.regexp_replace(bare, r"^\.+|[. ]+$", "")
    return F.when(bare == "", F.lit("Untitled")).otherwise(F.substring(bare, 1, 245))


def blockquote(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "\n"), lambda line: F.concat(F.lit("> "), line)), "\n")


def callout(c: Column, kind: str = "info", heading: str = "", fold: str = "") -> Column:
    return F.concat(F.lit(f"> [!{kind}]{fold} {heading}".rstrip() + "\n"), blockquote(c))


def link(c: Column, text: Column) -> Column:
    return F.concat(F.lit("["), text, F.lit("]("), c, F.lit(")"))


def image(c: Column, text: Column) -> Column:
    return F.concat(F.lit("!["), text, F.lit("]("), c, F.lit(")"))


def wikilink(c: Column, alias: Column | None = None) -> Column:
    return F.concat(F.lit("[["), c, *([F.lit("|"), alias] if alias is not None else []), F.lit("]]"))


def bullets(c: Column, style: str = "bullet") -> Column:
    mark = {"bullet": lambda i: F.lit("- "), "numbered": lambda i: F.concat((i + 1).cast("string"), F.lit(". ")), "task": lambda i: F.lit("- [ ] ")}[style]
    return F.array_join(F.transform(c, lambda x, i: F.concat(mark(i), x)), "\n")


def footnotes(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x, i: F.concat(F.lit("[^"), (i + 1).cast("string"), F.lit("]: "), x)), "\n\n")


def fragment_link(url: Column, text: Column) -> Column:
    return F.concat(url, F.lit("#:~:text="), F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")))


def table_text(rows: Column) -> Column:
    """A Markdown table of an array of arrays whose first row is the header."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.element_at(rows, 1), lambda x: F.lit("-")), " | "), F.lit(" |"))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)
    return F.array_join(F.concat(F.array(line(F.element_at(rows, 1)), rule), body), "\n")


def template(items: Column, before: str, after: str) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit(before), x, F.lit(after))), "")


def merge(c: Column, values: list[str]) -> Column:
    return F.concat(c, F.array(*[F.lit(v) for v in values]))


def calc(c: Column, op: str, value: float) -> Column:
    number = F.lit(float(value))
    return {"+": c + number, "-": c - number, "*": c * number, "/": F.try_divide(c, number), "^": F.pow(c, number), "**": F.pow(c, number)}[op]


def date_text(c: Column, form: str = "yyyy-MM-dd") -> Column:
    return F.date_format(c, form)


def date_modify(c: Column, amount: int, unit: str) -> Column:
    return F.timestamp_add(unit.upper(), F.lit(amount), c)


def duration_text(seconds: Column) -> Column:
    """Seconds as HH:mm:ss."""
    s = seconds.cast("long")
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    return F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s % 3600 / 60)), two(s % 60))


def decode_uri(c: Column) -> Column:
    """Percent-decoding; text that cannot be decoded stays."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))


def strip_tags(c: Column, keep: list[str] | None = None) -> Column:
    kept = "" if not keep else r"(?!/?(?:" + "|".join(keep) + r")\b)"
    return F.regexp_replace(c, r"(?s)<" + kept + r"/?[A-Za-z!][^>]*>", "")


def remove_tags(c: Column, names: list[str]) -> Column:
    """The named tags go, their content stays."""
    return F.regexp_replace(c, r"(?i)</?(?:" + "|".join(names) + r")\b[^>]*>", "")


def remove_html(c: Column, names: list[str]) -> Column:
    """The named elements go with all that is in them."""
    out = c
    for name in names:
        out = F.regexp_replace(out, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", "")
    return out


def replace_tags(c: Column, old: str, new: str) -> Column:
    return F.regexp_replace(c, rf"(?i)<(/?){old}\b", f"<$1{new}")


def strip_attr(c: Column, keep: list[str] | None = None) -> Column:
    """Attributes go, but for the named ones."""
    kept = "" if not keep else r"(?!(?:" + "|".join(keep) + r")\s*=)"
    return F.regexp_replace(c, r"\s+" + kept + r"[A-Za-z_:][-\w:.]*\s*=\s*(?:\"[^\"]*\"|'[^']*')", "")


def remove_attr(c: Column, names: list[str]) -> Column:
    return F.regexp_replace(c, r"\s+(?:" + "|".join(names) + r")\s*=\s*(?:\"[^\"]*\"|'[^']*')", "")


def strip_md(c: Column) -> Column:
    """Markdown marks go: headings, emphasis, code, links and images."""
    out = F.regexp_replace(c, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"(?m)^\s{0,3}(?:#{1,6}\s+|>\s?|[-*+]\s+|\d+\.\s+)", "")
    return F.regexp_replace(out, r"[*_`~]{1,3}", "")


def markdown(c: Column) -> Column:
    """HTML headings, emphasis, links, items and paragraphs as Markdown."""
    out = remove_html(c, ["script", "style"])
    for level in range(1, 7):
        out = F.regexp_replace(out, rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}>", "\n" + "#" * level + " $1\n")
    out = F.regexp_replace(out, r"(?is)<(?:b|strong)\b[^>]*>(.*?)</(?:b|strong)>", "**$1**")
    out = F.regexp_replace(out, r"(?is)<(?:i|em)\b[^>]*>(.*?)</(?:i|em)>", "*$1*")
    out = F.regexp_replace(out, r"(?is)<a\b[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>", "[$2]($1)")
    out = F.regexp_replace(out, r"(?is)<li\b[^>]*>(.*?)</li>", "\n- $1")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</?p\b[^>]*>", "\n")
    return trim(F.regexp_replace(strip_tags(out), r"\n{3,}", "\n\n"))


def objects(c: Column, what: str) -> Column:
    """Keys, values or entries of a JSON object."""
    parsed = F.from_json(c, "map<string,string>")
    return {"keys": F.map_keys(parsed), "values": F.map_values(parsed), "entries": F.map_entries(parsed)}[what]


def map_items(c: Column, expression: str) -> Column:
    """An arrow expression ``x => SQL`` over array items."""
    name, body = (p.strip() for p in expression.split("=>", 1))
    return F.transform(c, lambda x: _substitute(x, name, body))


def _substitute(x: Column, name: str, body: str) -> Column:
    """The few forms that templates use: the item, item with a literal by + - * /, or text around it."""
    import re

    m = re.fullmatch(rf"{name}\s*([-+*/])\s*([\d.]+)", body)
    if m:
        return calc(x.cast("double"), m[1], float(m[2]))
    m = re.fullmatch(rf'"([^"]*)"\s*\+\s*{name}(?:\s*\+\s*"([^"]*)")?', body)
    if m:
        return F.concat(F.lit(m[1]), x, F.lit(m[2] or ""))
    if body == name:
        return x
    raise ValueError(f"unsupported expression {body!r}")


# Ingest normalisers.

_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def lc_text(c: Column) -> Column:
    """Lower case with accents folded; white space stays."""
    return F.translate(F.lower(c), _ACCENTED, _PLAIN)


def number_form(c: Column) -> Column:
    """Sortable text of a decimal number: a sign, a letter of its exponent, E and its digits, so that text order is number order.

    Fixed format: + with a to z for exponents 0 to 25 and A to Z for -26 to -1;
    ! with Z to A for 0 to 25 and a to z for -1 to -26, and ten less the digits;
    zero is +AE0.  Digits are taken from the text, so none is lost.  Text of the
    format stays as it is; numbers beyond, and what is none, are null.
    """
    raw = F.trim(c.cast("string"))
    pattern = r"^([+-]?)([0-9]*)[.]?([0-9]*)(?:[eE]([+-]?[0-9]+))?$"
    part = lambda group: F.regexp_extract(raw, pattern, group)
    whole, digits = part(2), F.concat(part(2), part(3))
    led = F.regexp_replace(digits, "^0+", "")
    kept = F.regexp_replace(led, "0+$", "")
    exponent = F.length(whole) - 1 - (F.length(digits) - F.length(led)) + F.coalesce(part(4).try_cast("int"), F.lit(0))
    head, tail = F.substring(kept, F.lit(1), F.length(kept) - 1), F.substring(kept, F.length(kept), F.lit(1))
    turned = F.concat(F.translate(head, "0123456789", "9876543210"), (F.lit(10) - tail.try_cast("int")).cast("string"))
    point = lambda d: F.concat(F.substring(d, 1, 1), F.when(F.length(d) > 1, F.concat(F.lit("."), F.substring(d, F.lit(2), F.length(d)))).otherwise(F.lit("")))
    up = F.concat(F.lit("+"), F.char(F.when(exponent >= 0, 97 + exponent).otherwise(91 + exponent)), F.lit("E"), point(kept))
    down = F.concat(F.lit("!"), F.char(F.when(exponent >= 0, 90 - exponent).otherwise(96 - exponent)), F.lit("E"), point(turned))
    number = F.rlike(raw, F.lit(pattern)) & (F.length(digits) > 0)
    formed = F.when(number & (kept == ""), F.lit("+AE0")).when(number & exponent.between(-26, 25), F.when(part(1) == "-", down).otherwise(up))
    return F.when(F.rlike(raw, F.lit("^[!+][A-Za-z][Ee][0-9].?[0-9]*$")), raw).otherwise(formed)


def date_form(c: Column) -> Column:
    """ISO 8601 in UTC with milliseconds, from several spellings; null if none fits."""
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyyMMdd", "MM/dd/yyyy", "yyyyMMddHHmmss"]
    parsed = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in forms])
    return F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def ip_form(c: Column) -> Column:
    """Version 4 addresses with each part padded to three digits; others stay, in lower case."""
    parts = F.split(c, r"\.")
    v4 = F.regexp_like(c, F.lit(r"^\d{1,3}(\.\d{1,3}){3}$"))
    return F.when(v4, F.array_join(F.transform(parts, lambda p: F.lpad(p, 3, "0")), ".")).otherwise(F.lower(c))


def geo_form(lat: Column, lon: Column, places: int = 6) -> Column:
    return F.format_string(f"%.{places}f,%.{places}f", lat.cast("double"), lon.cast("double"))


def mask(c: Column, keep_last: int = 0, token: str = "*") -> Column:
    """All but the last characters become the token."""
    if keep_last == 0:
        return F.lit("[REDACTED]")
    hidden = F.greatest(F.length(c) - keep_last, F.lit(0))
    return F.concat(F.repeat(F.lit(token), hidden), F.substring(c, hidden + 1, keep_last))


def composite(*columns: Column, separator: str = "|") -> Column:
    return F.concat_ws(separator, *columns)


def content_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


# URLs.

#: Query parameters that only track visitors.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content gclid fbclid mc_cid mc_eid ref ref_src".split()


def url_domain(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def url_normal(c: Column) -> Column:
    """Lower-case scheme and host, without fragment, tracking parameters and a closing slash."""
    bare = F.regexp_replace(c, r"#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    path = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(TRACKING))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise(F.lit(""))
    return F.concat(head, F.regexp_replace(path, r"/+$", ""), tail)


def url_fingerprint(url: Column, method: str = "GET", body: Column | None = None) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit(method.upper()), url_normal(url), body if body is not None else F.lit("")).cast("binary"), 256)


def source_class(c: Column) -> Column:
    """A coarse class of a URL by its host."""
    host = url_domain(c)
    return (
        F.when(host.rlike(r"(^|\.)(github|gitlab|bitbucket)\."), "code")
        .when(host.rlike(r"(^|\.)(arxiv|doi|pubmed)\."), "paper")
        .when(host.rlike(r"(^|\.)(wikipedia|wikidata)\."), "reference")
        .when(host.rlike(r"\.(gov|mil)$"), "government")
        .when(host.rlike(r"\.edu$"), "education")
        .when(host.rlike(r"^(blog|m)\."), "blog")
        .otherwise("web")
    )


def extract_emails(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"), 1))


def keyword_flag(c: Column, words: list[str]) -> Column:
    return F.lower(c).rlike(r"\b(?:" + "|".join(words) + r")\b")


def compensation(c: Column) -> Column:
    """The first amount of money of a text."""
    return F.regexp_extract(c, r"([$€£]\s?\d[\d,]*(?:\.\d+)?\s?[kK]?(?:\s?(?:-|–|to)\s?[$€£]?\s?\d[\d,]*(?:\.\d+)?\s?[kK]?)?)", 1)


def dictionary_match(c: Column, words: list[str]) -> Column:
    found = F.split(F.lower(c), r"[^\p{L}\p{N}+#.]+")
    return F.array_sort(F.array_intersect(found, F.array(*[F.lit(w) for w in words])))


def canonical_body_hash(c: Column) -> Column:
    return F.sha2(trim(F.regexp_replace(F.lower(c), r"\s+", " ")).cast("binary"), 256)


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes STRUCT<x1, y1, x2, y2> over their union."""
    zero = F.lit(0.0)
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), zero)
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), zero)
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return F.when(area(a) + area(b) - w * h > 0, w * h / (area(a) + area(b) - w * h)).otherwise(zero)
