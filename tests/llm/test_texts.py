"""op1, op3, op4, op5, op6, op8, op10 against brute force and on odd rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import bpe, decontamination, html, langid, pii, queries, substring, textscan, toxicity
from tests.compare import duck_rows, spark_rows
from tests.conftest import SF
from tests.llm.frames import documents, empty_documents, odd_documents


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    columns, rows = spark_rows(queries.QUERIES[name](spark, SF))
    expected_columns, expected = duck_rows(queries.ORACLE_SQL[name], SF)
    assert columns == expected_columns and rows == expected


def test_words_and_runs():
    texts = ["The cat, the CAT", None, "", "é1 b", "one"]
    words = textscan.scan(pa.array(texts), textscan.ALNUM)
    assert words.rows.tolist() == [0, 0, 0, 0, 3, 3, 4]
    assert words.hashes[1] == words.hashes[3] and words.hashes[0] == words.hashes[2]
    rows, _ = textscan.run_hashes(words, 3)
    assert rows.tolist() == [0, 0, 3, 4]


# op3


def brute_contamination(text, items, n=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    words, hits, named = split(text), set(), set()
    for item, body in items:
        own = split(body)
        for k in range(max(1, len(own) - n + 1) if own else 0):
            window = own[k : k + n]
            for at in range(len(words) - len(window) + 1):
                if words[at : at + len(window)] == window:
                    hits |= set(range(at, at + len(window)))
                    named.add(item)
    return len(words), len(hits), len(named), hashlib.sha256(",".join(sorted(map(str, named))).encode()).hexdigest()


@pytest.mark.parametrize("params", [{}, {"broadcast_rows": 0}, {"filter_bits": 12, "broadcast_rows": 1}])
def test_contamination(spark, params):
    """Also with nothing broadcast, and with filters so small that they pass nearly everything."""
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "The", "x1", "été"])
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 3, 10, 14])))) for k in range(9)] + [(50, None), (51, ""), (52, "...")]
    rows = []
    for i in range(40):
        body = " ".join(word() for _ in range(rng.randint(0, 60)))
        rows.append((i, body + (" - " + items[i % 9][1].upper().replace("É", "é") if i % 3 == 0 else "")))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    p = decontamination.DecontaminationParams(**params)
    got = {r["doc_id"]: tuple(r)[1:5] for r in decontamination.contamination_report(documents(spark, rows), benchmark, p).collect()}
    assert got == {i: brute_contamination(t, items) for i, t in rows}


def test_contamination_odd_rows(spark):
    benchmark = spark.createDataFrame([(1, "one"), (None, "some text here and more of it"), (2, None)], "item_id long, text string")
    got = decontamination.contamination_report(odd_documents(spark), benchmark).collect()
    assert len(got) == 12
    assert [r["n_items"] for r in got if r["doc_id"] in (4, 6)] == [1, 1]
    assert decontamination.contamination_report(empty_documents(spark), benchmark).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    kept = decontamination.drop_contaminated(odd_documents(spark), none)
    assert kept.count() == 12 and kept.columns == odd_documents(spark).columns


def test_contamination_names_of_any_type(spark):
    benchmark = spark.createDataFrame([("item-b", "one two three"), ("item-a", "one two three"), ("item-a", "four")], "item_id string, text string")
    docs = spark.createDataFrame([("x", "zero ONE, two three four"), ("y", "one two")], "doc_id string, text string").withColumn("r", F.lit(1)).withColumn("found", F.lit(2))
    got = {r["doc_id"]: tuple(r)[1:5] for r in decontamination.contamination_report(docs, benchmark).collect()}
    assert got["x"] == (5, 4, 2, hashlib.sha256(b"item-a,item-b").hexdigest()) and got["y"][1] == 0
    assert [r["doc_id"] for r in decontamination.drop_contaminated(docs, benchmark).collect()] == ["y"]


def test_skewed_joins_are_whole(spark):
    from lodestrata.llm.joins import skew_join

    left = spark.range(6000).select((F.when(F.col("id") < 5000, 7).otherwise(F.col("id") % 50)).alias("k"), "id")
    right = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = skew_join(left, right, "k", ["id"], broadcast_rows=0, parts=10)
    assert got.count() == 6000 and got.where("v <> 2 * k").count() == 0
    assert "_salt" not in got.columns


def test_filters_hold_what_they_were_given(spark):
    from lodestrata.llm.joins import HashFilter

    known = textscan.mix(np.arange(3000, dtype=np.uint64))
    df = spark.createDataFrame([(int(x),) for x in known.view(np.int64)], "h long")
    for bits in (12, 26):
        found = HashFilter.of(df, "h", bits)
        assert found.has(known).all() and len(found.table) * 64 <= 1 << bits
    assert found.has(textscan.mix(np.arange(10**6, 10**6 + 3000, dtype=np.uint64))).mean() < 0.05
    assert not HashFilter.of(df.limit(0), "h").has(known).any()


# op4


def brute_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_base_spans():
    rng = random.Random(4)
    for _ in range(4000):
        t = "".join(rng.choice("aé0011234.@@+- ()%_25\n") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute_spans(t)
    assert pii.base_spans("4111111111111111 é a@b.co") == [("email", 19, 25), ("card", 0, 16)]


def test_added_spans_and_redaction(spark):
    rows = [(k, f'text of {k} token = "{hashlib.sha1(str(k).encode()).hexdigest()}" and mail a{k}@b.org end') for k in range(60)]
    rows += [(k, f"plain words of number {k} with nothing to hide at all") for k in range(60, 120)]
    got = {r["doc_id"]: r for r in pii.find_personal_data(documents(spark, rows)).collect()}
    assert all("secret:" in got[k]["spans"] and got[k]["n_email"] == 1 for k in range(60))
    assert all(got[k]["spans"] == "" for k in range(60, 120))
    out = pii.redact_documents(documents(spark, rows))
    first = out.where("doc_id = 0").first()
    assert "<SECRET>" in first["text"] and "<EMAIL>" in first["text"] and first["n_chars"] == len(first["text"])
    assert pii.redact("abcdef", [("card", 1, 3), ("ip", 2, 5)]) == "a<CARD>f"


def brute_candidates(text):
    """Plain searches of each added kind, every place against every base span."""
    words = r"(?:[A-Za-z0-9-]+)"
    found = [("secret", m.span()) for m in re.finditer(r"(?<![A-Za-z0-9])[A-Za-z0-9_]{20,}", text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    found += [("account", m.span()) for m in re.finditer(r"[0-9](?:[ -]?[0-9])+", text) if 12 <= len(re.sub("[ -]", "", m[0])) <= 19]
    found += [("local_phone", m.span()) for m in re.finditer(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", text)]
    found += [("masked_email", m.span()) for m in re.finditer(rf"[A-Za-z0-9._%+-]+ ?[\[(](?:at|AT)[\])] ?{words}(?:(?: ?[\[(](?:dot|DOT)[\])] ?|\.){words})+", text)]
    found += [("national_id", m.span()) for m in re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", text)]
    base = brute_spans(text)
    return {(k, a, b) for k, (a, b) in found if not any(x < b and a < y for _, x, y in base)}


def test_candidates_against_plain_searches():
    rng = random.Random(12)
    parts = ["a1b2c3d4e5f6a7b8c9d0e1", "4111 1111 1111 1111", "4111 1111 1111 1112", "555-123-4567", "(212) 555-9999", "ab.c [at] d-e [dot] org", "x(at)y.com", "123-45-6789", "a@b.co", "1.2.3.4", "+1 212 555 1234", "word", "_", "-", ".", "secret:", "token = "]
    seen = set()
    for _ in range(3000):
        text = rng.choice(["", " "]).join(rng.choice(parts) for _ in range(rng.randint(1, 8)))
        got = {(c.kind, c.start, c.end) for c in pii.candidates(text, pii.base_spans(text)) if c.kind in ("secret", "account", "local_phone", "masked_email", "national_id")}
        assert got == brute_candidates(text), text
        seen |= {k for k, *_ in got}
    assert len(seen) == 5


def test_all_labelers_vote_on_all_kinds():
    texts = {
        "iban": ["IBAN: DE89 3704 0044 0532 0130 00 here", "order ZZ89 3704 0044 0532 0130 01 here"],
        "national_id": ["SSN: 536-22-1234 now", "tracking 000-12-0000 now", "as in 123-45-6789 now"],
        "birth_date": ["born 12.03.1980 in", "birth: 45.13.2090 at"],
        "person": ["signed: Maria Lopez now", "by Dr. Smith now"],
        "address": ["lives at 12 Oak Street now", "see Lindenweg 5 now", "address: 4 Elm St now"],
        "masked_email": ["mail: a.b [at] c [dot] org now", "revision a[at]b.zzz now"],
        "local_phone": ["phone: 212-555-9999 now", "invoice 011-155-0199 now", "tel (212) 667-9999"],
        "secret": ['token = "sk_' + "a1" * 90 + '" now', "commit abcdefghijklmnopqrstuvwx1 now", "x" + "0123456789abcdef" * 2],
        "account": ["card: 378282246310005 now", "order 4012888888881881222 now", "isbn 0999999999999 now"],
    }
    for kind, examples in texts.items():
        found = [c for t in examples for c in pii.candidates(t, []) if c.kind == kind]
        assert len(found) >= len(examples), kind
        votes = np.array([c.votes for c in found])
        assert votes.any(axis=0)[:3].all(), (kind, votes)  # shape, gazetteer and cue


def test_reliabilities_are_learned_whatever_the_size():
    """A rare class, and labelers whose rates are not those assumed: the posterior follows the votes."""
    rng = np.random.default_rng(3)
    for n in (20_000, 400_000):
        truth = rng.random(n) < 0.02
        yes = [[0.01, 0.09, 0.90], [0.02, 0.18, 0.80], [0.05, 0.15, 0.80], [0.01, 0.29, 0.70], [0.02, 0.03, 0.95]]
        no = [[0.90, 0.07, 0.03], [0.55, 0.40, 0.05], [0.30, 0.68, 0.02], [0.30, 0.69, 0.01], [0.50, 0.02, 0.48]]
        votes = np.stack([np.where(truth, rng.choice(3, n, p=y), rng.choice(3, n, p=x)) - 1 for y, x in zip(yes, no)], axis=1)
        patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
        belief = pii.estimate(patterns, counts.astype(float))[inverse.ravel()]
        exact = np.full(n, np.log(0.02 / 0.98))
        for k in range(5):
            exact += np.log(np.array(yes[k])[votes[:, k] + 1] / np.array(no[k])[votes[:, k] + 1])
        assert ((belief > 0.5) == (exact > 0)).mean() > 0.998
        assert abs(belief.mean() - 0.02) < 0.004


def test_added_kinds_end_to_end(spark):
    rows = [(k, f"text {k} born {k % 28 + 1:02d}.03.19{k % 60 + 20} and mail: a{k} [at] b [dot] org, lives at {k + 1} Oak Street, IBAN: DE89 3704 0044 0532 0130 00.") for k in range(80)]
    rows += [(k, f"order {k} of 12.03.2017 was sent, number 49{k:04d}5511229{k % 7}, page 3, and that is all") for k in range(80, 200)]
    rows.append((200, 'key = "' + "a1B2" * 60 + '"'))
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(documents(spark, rows)).collect()}
    for kind in ("birth_date", "masked_email", "address", "iban"):
        assert all(kind + ":" in got[k] for k in range(80)), kind
    assert all(got[k] == "" for k in range(80, 200))
    assert got[200] == "secret:7:247"


def test_long_texts_take_linear_time():
    import time

    model = pii.train([])
    for unit in ("a.b@c.de 1234 ", "_a", "Anna Maria ", "1 ", "a [at] ", "4111111111111111 "):
        start = time.time()
        pii.all_spans(unit * (2_000_000 // len(unit)), model)
        assert time.time() - start < 20, unit


def test_personal_data_odd_rows(spark):
    assert pii.find_personal_data(odd_documents(spark)).count() == 12
    assert pii.find_personal_data(empty_documents(spark)).count() == 0
    assert pii.redact_documents(odd_documents(spark)).count() == 12


# op5


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    return bpe.compile_tokenizer(open(path, "rb").read()), Tokenizer.from_file(path)


def test_tokens_are_those_of_the_library(tokenizer):
    own, library = tokenizer
    rng = random.Random(2)
    letters = [chr(c) for c in range(0x250)] + list("東あ\U0001f600‍’²\x1c⁠١") + ["'s", "'ll", " ", "  ", "\n", "the", "ing", "<|endoftext|>", "aaaa", "###", "***"]
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == np.array(ids, "<u4").tobytes()
        assert own.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)
    broken = np.array([own.number[b"\xe2"], own.number[b"a"]])
    assert own.decode(broken) == library.decode(broken.tolist(), skip_special_tokens=False)


def test_automaton_arcs_agree_with_its_states(tokenizer):
    own, _ = tokenizer
    rng = random.Random(3)
    tokens = list(own.number.values())
    for _ in range(3000):
        x, y = rng.choice(tokens), rng.choice(tokens)
        assert own.accepts(own.target[x], y) == own.arc(x, y)


def test_long_words(tokenizer):
    own, library = tokenizer
    for text in ("a" * 20000, "=-" * 3000 + "\n" * 500, "ab1" * 4000):
        assert own.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_words_are_cut_as_the_library_cuts_them(tokenizer):
    """Every code point between letters, digits, blanks and itself, the pieces of long texts, and what is refused."""
    import json

    from tokenizers.pre_tokenizers import ByteLevel

    own, library = tokenizer
    splitter = ByteLevel(add_prefix_space=False, use_regex=True)
    for c in [*range(0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE0200)]:
        text = f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)}! x"
        assert own.split(text) == [text[a:b] for _, (a, b) in splitter.pre_tokenize_str(text)], hex(c)
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice(["a", "12", " ", "  ", "\n", "\x85", "'s", "é", "€", "\x1c", ". "]) for _ in range(400))
        assert own._plain(text, piece=7) == own._plain(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    content = json.loads(open(queries.tokenizer_path(), "rb").read())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": content["model"] | {"ignore_merges": True}}):
        with pytest.raises(ValueError):
            bpe.compile_tokenizer(json.dumps(content | change).encode())


def test_round_trip(spark):
    p = bpe.BpeParams(queries.tokenizer_path())
    docs = odd_documents(spark)
    encoded = bpe.encode_documents(docs, p, ["doc_id"])
    texts = sorted((r["text"] or "") for r in docs.select("text").collect())
    assert sorted(r["text"] for r in bpe.decode_documents(encoded, p, ["doc_id"]).collect()) == texts
    digests = bpe.token_digests(docs, p).collect()
    assert sorted(r["decoded_sha256"] for r in digests) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    assert bpe.token_digests(empty_documents(spark), p).count() == 0


# op6


def test_repeated_passages(spark):
    passage = "This passage holds a good many words so that it counts. It goes on for another sentence of some length too. And it ends with a third one that is long enough."
    rows = [(2, "Own start of two here. " + passage + " Own end."), (1, "First words are mine.\n" + passage), (3, "Nothing of the sort. At all."), (4, passage + " " + passage)]
    got = {r["doc_id"]: r for r in substring.remove_repeats(documents(spark, rows)).collect()}
    assert got[1]["n_removed"] == 0 and got[3]["n_removed"] == 0
    assert got[2]["text"] == "Own start of two here. Own end." and got[2]["n_removed"] == 3
    assert got[4]["text"] == "" and got[4]["n_removed"] == 6


def test_repeated_short_sentences(spark):
    """A 60-word passage of sentences of one to five words, no two neighbours of which have twelve words."""
    passage, n, sizes = "", 0, [1, 5, 2, 4, 3]
    while n < 60:
        size = sizes[n // 3 % 5]
        passage, n = passage + " ".join(f"word{n + i}" for i in range(size)) + ". ", n + size
    rows = [(1, "Something before it. " + passage + "After it."), (2, "Quite another start. " + passage + "Other end."), (3, "yes. no. " * 5)]
    got = {r["doc_id"]: r for r in substring.remove_repeats(documents(spark, rows)).collect()}
    assert got[1]["text"] == rows[0][1]
    assert got[2]["text"] == "Quite another start. Other end."
    assert got[3]["n_removed"] == 0  # ten words


def test_every_repeated_stretch_is_covered():
    """Against brute force: the sentences of all repeated stretches of two or more sentences and twelve or more words."""
    rng = random.Random(6)
    for _ in range(30):
        pool = [" ".join(rng.choice("abc") for _ in range(size)) + ". " for size in (1, 2, 3, 4, 5, 9)]
        texts = ["".join(rng.choices(pool, k=25)) for _ in range(3)]
        rows, places, one, two = substring.SentenceIndex(pa.array(texts)).spans(substring.SubstringParams())
        parts = [[t[a:b].strip() for a, b in substring.sentences(t)] for t in texts]
        seen, covered = {}, set()
        for r, ss in enumerate(parts):
            for k in range(len(ss)):
                for m in range(k + 2, len(ss) + 1):
                    if sum(len(s.split()) for s in ss[k:m]) >= 12 and seen.setdefault(tuple(ss[k:m]), (r, k)) != (r, k):
                        covered |= {(r, i) for i in range(k, m)}
        first, got = {}, set()
        for r, place, h in sorted(zip(rows.tolist(), places.tolist(), zip(one.tolist(), two.tolist()))):
            if first.setdefault(h, (r, place)) != (r, place):
                got |= {(r, i) for i in range(place >> 8, (place >> 8) + (place & 255))}
        assert got == covered and got


def test_sentences_rebuild_the_text():
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice("ab.!? \n\t") for _ in range(rng.randint(0, 30)))
        spans = substring.sentences(text)
        assert "".join(text[a:b] for a, b in spans) == text
        n = len(spans) if text.strip(" \n\t") else int(bool(text))
        edges = substring.SentenceIndex(pa.array([text])).edges
        assert max(int(edges[1]), int(bool(text))) == n


def test_repeats_odd_rows(spark):
    assert substring.remove_repeats(odd_documents(spark)).count() == 12
    assert substring.remove_repeats(empty_documents(spark)).count() == 0


# op8


def test_main_text():
    body = "The cat is on the mat and it was of the house to be seen by all. " * 3
    page = (
        '<html><head><title>T</title><style>p{}</style></head><body><header><a href="/">Home</a> Site</header><nav>Menu of the site and of all</nav>'
        f'<div class="cookie-notice"><p>{body}</p></div><div id="main"><h1>Title &amp; more</h1><p>{body}</p><p>Short&nbsp;<b>en</b>d.</p>'
        f'<div class="comments"><p>{body}</p></div></div><aside>{body}</aside><form><p>{body}</p></form><script>var x="</p>";</script><footer>{body}</footer></body></html>'
    )
    assert html.main_text(page) == f"Title & more {body.strip()} Short end."
    assert html.main_text(None) == html.main_text("") == "" and html.main_text("<p>") == ""
    assert html.main_text("<article><p>x<p>1 &lt; 2<br>y</article>") == "x 1 < 2 y"


def test_markup_in_attributes():
    words = "This is the text of the page and it goes on for a while so that it is long enough to be kept as the main text of it. " * 3
    markup = "<b>leak</b> " * 50
    assert [b.text for b in html.blocks(f"<div data-x='{markup}'><p>{words}</p></div>")] == [words.strip()]
    assert [b.text for b in html.blocks(f'<div data-x = "{markup}"><p title="a"b">{words}</p></div>')] == [words.strip()]


def test_pages_odd_rows(spark):
    rows = [(1, None, None), (1, "u", ""), (None, "u", "<article>a b</article>"), (2, "u", "<" * 3000), (3, "u", "<div>" * 5000 + "x")]
    out = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == 5 and {r["n_chars"] for r in out if r["page_id"] is None} == {3}
    assert html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# op10 and op1


def test_languages_held_out(spark):
    from lodestrata.runtime import table

    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    rows = langid.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)


def test_other_languages_are_dropped(spark):
    from lodestrata.runtime import table

    docs = table(spark, SF, "documents")
    filters = langid.fit_filters(docs)
    assert langid.keep_recognised(docs, filters).count() == docs.count()
    others = ["Wszystkie zwierzęta są równe, ale niektóre są równiejsze od innych.", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.", "xqzv wkjpl qqrtz mnbvc zzxkj plokw qazws edcrf tgbyh"]
    assert langid.keep_recognised(documents(spark, list(enumerate(others))), filters).count() == 0


def test_more_than_64_languages():
    grams = [np.unique(np.random.default_rng(k).integers(0, 2**63, 50, dtype=np.uint64)) for k in range(70)]
    filters = langid.LanguageFilters([f"l{k:02d}" for k in range(70)], grams, langid.LanguageParams())
    slots = list(filters._slots(grams[69]))
    found = filters.table[1][slots[0]] & filters.table[1][slots[1]] & filters.table[1][slots[2]]
    assert ((found >> np.uint64(5)) & np.uint64(1)).all()


def test_languages_odd_rows(spark):
    got = langid.identify_languages(odd_documents(spark)).collect()
    assert len(got) == 12
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 8)} == {"und"}
    assert {r["lang_pred"] for r in got if r["doc_id"] in (5, 9)} == {"en"}
    assert langid.identify_languages(empty_documents(spark)).count() == 0


def toxic_sample(n, seed):
    rng = random.Random(seed)
    syllables = ["an", "er", "th", "on", "in", "es", "re", "ti", "ha", "ou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    rows = []
    for k in range(n):
        words = [word() for _ in range(rng.randint(20, 80))]
        bad = k % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "zgrumblix" + rng.choice(syllables))
        rows.append((" ".join(words), int(bad)))
    return rows


def test_toxic_misspellings_are_found():
    rows = toxic_sample(900, 1)
    model = toxicity.fit([t for t, _ in rows], np.array([y for _, y in rows]))
    unseen = [(t.replace("zgrumblix", "zgrumbliks"), y) for t, y in toxic_sample(200, 2)]
    score = model.score(pa.array([t for t, _ in unseen]))
    truth = np.array([y for _, y in unseen])
    assert score[truth == 1].mean() > score[truth == 0].mean() + 0.4
    assert (score[truth == 0] >= 0.7).mean() < 0.05


def test_only_copies_within_a_label_count_once():
    """A footer that all texts share drops none; near copies go, but not those with another label."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    footer = " ".join(word() for _ in range(30))
    texts = [" ".join(word() for _ in range(70)) + " " + footer for _ in range(300)]
    assert len(toxicity.distinct_texts(texts, np.zeros(300, int))) == 300
    copies = [texts[0], texts[0], "x " + texts[0], texts[0], "", ""]
    assert toxicity.distinct_texts(copies, np.array([0, 0, 0, 1, 0, 0])).tolist() == [0, 3, 4]


def test_scores_against_plain_sums():
    """The score of a text from its words' n-grams one by one; long texts in pieces score the same."""
    p = toxicity.ToxicityParams(bucket_bits=12)
    table = np.random.default_rng(1).normal(size=1 << 12).astype(np.float32)
    model = toxicity.ToxicityModel(table, 0.25, p)

    def bucket(values, n):
        h = np.uint32(0)
        with np.errstate(over="ignore"):
            for k, v in enumerate(values):
                h = v if k == 0 else h * toxicity._K + v
            return int(((h * np.uint32(2246822519) + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - p.bucket_bits))

    def plain(text):
        means = []
        for word in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode()):
            padded = [toxicity._FOLD[b] for b in b" " + word + b" "]
            grams = [bucket(padded[k : k + n], n) for n in p.orders for k in range(len(padded) - n + 1)]
            whole = toxicity.SubwordBags(pa.array([word.decode()], pa.large_string()), p).word_buckets()[0]
            means.append(np.mean([table[g] for g in [*grams, whole]]))
        return np.mean(means) + 0.25 if means else 0.25

    texts = ["Some words here", "a", "été, déjà vu!", "", "x1 y22 z333 " * 5]
    assert np.allclose(model.logits(pa.array(texts, pa.large_string())), [plain(t) for t in texts], atol=1e-5)
    long = pa.array(["one two three, four " * 500], pa.large_string())
    whole, n = toxicity.SubwordBags(long, p).row_sums(table)
    pieces, m = model._long(long, piece=100)
    assert n == m and np.allclose(whole, pieces)
    buckets = toxicity.SubwordBags(pa.array(["form from Form"], pa.large_string()), toxicity.ToxicityParams()).word_buckets()
    assert buckets[0] != buckets[1] and buckets[0] == buckets[2]


def test_scans_in_pieces_are_the_same():
    rng = random.Random(11)
    texts = ["".join(rng.choice(["ab", "é", " ", "\n", "-", "x" * 30]) for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["", None]
    for kind in (textscan.ALNUM, textscan.SPACED):
        whole, pieces = textscan.scan(pa.array(texts), kind), textscan.scan(pa.array(texts), kind, chunk=16)
        for name in ("starts", "ends", "rows", "hashes"):
            assert (getattr(whole, name) == getattr(pieces, name)).all()


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (6, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(odd_documents(spark), labels).collect()
    assert len(got) == 12 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(empty_documents(spark), labels).count() == 0
    assert toxicity.toxicity(odd_documents(spark), labels.limit(0)).count() == 12
