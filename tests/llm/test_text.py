"""Tokens, languages, personal data, URLs, fingerprints, decontamination and toxicity."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartlens.llm import bpe, decontaminate, fingerprint, language, pii, queries, toxicity, urls
from cartlens.llm.arrays import block_of
from samples import docs, empty, make_words, rows  # noqa: F401  fixtures

RANKS, PATTERN = queries.rank_file(), queries.split_pattern()


def test_tokens_round_trip(docs, rows, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_CHARS", 500)
    encoding = bpe.encoder(RANKS, PATTERN)
    both = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN)
    got = {r["doc_id"]: (r["token_ids"], bytes(r["decoded"])) for r in both.select("doc_id", "token_ids", "decoded").collect()}
    assert got == {i: (encoding.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows}
    once = bpe.encode(docs, RANKS, PATTERN, bytes_col="decoded").select("doc_id", "token_ids", "decoded").collect()
    assert {r["doc_id"]: (r["token_ids"], bytes(r["decoded"])) for r in once} == got


def test_pieces_keep_matches():
    rng = random.Random(2)
    encoding = bpe.encoder(RANKS, PATTERN)
    for _ in range(200):
        text = "".join(rng.choice(["a", "bc", " ", "  ", "\n", "\n\n ", "'s", "'", "12", "é", "!", "\t", "\u00a0"]) for _ in range(60))
        pieces = list(bpe.safe_pieces(text, 5))
        assert "".join(pieces) == text
        assert [i for p in pieces for i in encoding.encode_ordinary(p)] == encoding.encode_ordinary(text)


def test_pieces_keep_matches_around_separators():
    """U+001C to U+001F are no white space to the splitting pattern."""
    rng = random.Random(6)
    encoding = bpe.encoder(RANKS, PATTERN)
    whole = re.compile(r"[\S\x1c-\x1f]+")
    for _ in range(300):
        text = "".join(rng.choice(["a", "!", "!", "\x1c", "\x1d", "\x1e", "\x1f", " ", "\n", "\u0085", "é"]) for _ in range(60))
        pieces = list(bpe.safe_pieces(text, 5))
        assert "".join(pieces) == text and [w for p in pieces for w in whole.findall(p)] == whole.findall(text)
        assert [i for p in pieces for i in encoding.encode_ordinary(p)] == encoding.encode_ordinary(text)


def test_languages(spark, empty):
    rng = random.Random(4)
    syllables = {"xx": ["ba", "lo", "mi"], "yy": ["tch", "krü", "sz"], "zz": ["ai", "oe", "ué"]}
    say = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(n))
    train = [(say(k, 60), k) for k in syllables for _ in range(6)] + [(None, "xx"), ("ba", None), ("", "yy")]
    model = language.train(spark.createDataFrame(train, "text string, lang string"))
    assert model.languages == ["xx", "yy", "zz"]
    tests = [(say("xx", 30), "x", 0.99), (say("yy", 3), "y", 0.99), (say("xx", 60) + " " + say("zz", 30), "x", 0.5)]
    odd = [None, "", "123 !!", "×", "。"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([t for t, _, _ in tests] + odd)], "lang_score long, text string")
    got = language.identify(df.withColumnRenamed("lang_score", "k"), model).orderBy("k").collect()
    for r, (_, lang, least) in zip(got, tests, strict=False):
        assert r["lang_pred"] == lang * 2 and least <= r["lang_score"] <= 1
    assert got[2]["lang_mix"][0].startswith("xx:0.6") and got[2]["lang_mix"][1].startswith("zz:0.3")
    assert [(r["lang_pred"], r["lang_score"]) for r in got[3:]] == [("und", 0.0)] * len(odd)
    assert language.identify(empty, model).count() == 0
    nothing = language.train(empty)
    assert {r["lang_pred"] for r in language.identify(df, nothing).collect()} == {"und"}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(t):
    digits = lambda m: re.sub(r"\D", "", m[0])
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]


def test_plain_identifiers_equal_the_patterns():
    rng = random.Random(8)
    atoms = list("0123456789") * 3 + list("ab.@+-_ ()%é\n") + ["4111111111111111", "10.0.0.1", "x@y.zz", "+1 (555) 555-0100", "5500 0000 0000 0004"]
    for _ in range(3000):
        text = "".join(rng.choices(atoms, k=rng.randint(0, 40)))
        assert pii.detect(text) == brute_pii(text), text


@pytest.mark.parametrize(
    "text,kind,part",
    [
        ("é write to jane.doe at mail dot com now", "email", "jane.doe at mail dot com"),
        ("é x [at] y (dot) org", "email", "x [at] y (dot) org"),
        ("mail ｊｏｈｎ＠ｍａｉｌ．ｃｏｍ hi", "email", "ｊｏｈｎ＠ｍａｉｌ．ｃｏｍ"),
        ("mail jоhn@mаil.com here", "email", "jоhn@mаil.com"),
        ("the.34 at mail7.example.com", "email", "the.34 at mail7.example.com"),
        ("call plus one two three four five six seven eight nine zero ok", "phone", "plus one two three four five six seven eight nine zero"),
        ("call +1 (two one two) 555-0199.", "phone", "+1 (two one two) 555-0199"),
        ("card four" + " one" * 15 + " end", "card", "four" + " one" * 15),
        ("ip ten is not, but one nine two dot one six eight dot zero dot one is", "ip", "one nine two dot one six eight dot zero dot one"),
        ("ip １０.２.３.４ wide", "ip", "１０.２.３.４"),
        ("card ４１１１ 1111 1111 1111 wide", "card", "４１１１ 1111 1111 1111"),
    ],
)
def test_disguised_identifiers_map_back(text, kind, part):
    some, odd = pii.hints(block_of([text.encode()]))
    base, added = pii.spans(text, bool(odd[0]))
    at = text.index(part)
    assert (pii.KINDS.index(kind), at, at + len(part)) in added
    assert not [s for s in added if s in base]


def test_hints_lose_no_disguise():
    """Every row that rewriting would add spans to has a hint."""
    rng = random.Random(3)
    atoms = [*pii._DIGIT_NAMES, "Zéro", "FÜNF", "plus", "más", "Plus", *"0123456789", *"0123456789", "555", "4111", "192.168.1.", "10.0", "+", "+1 ", "(", ")", "jane.doe", "x7", "mail.com", "@"]
    atoms += [" at ", "  at  ", "[ at ]", "(  AT)", " dot ", "[  dot ]", " ät ", "{ Ät }", " arroba ", " punkt "] + [" "] * 40 + list(".-,;/_\n×é") * 2
    texts = ["".join(rng.choices(atoms, k=rng.randint(3, 30))) for _ in range(30000)]
    texts += ["+1 555 four 123 4567", "192.168.1.five", "+1 555 123 456 seven eight", "x [  at  ] y.org", "a7 ät b.de", "+33 un 2345678", "+1 555 oh 123 4567"]
    _, odd = pii.hints(block_of([t.encode() for t in texts]))
    added = [bool(pii.spans(t, True)[1]) for t in texts]
    assert sum(added) > 500 and all(added[-7:])
    assert [t for t, a, o in zip(texts, added, odd, strict=True) if a and not o] == []


def test_prose_is_left_alone():
    for text in ["we met at noon. dot the i at one point", "seven eight nine ten", "look at 3.5 points", "uno de los dos", "a @ b", "plus one two three"]:
        some, odd = pii.hints(block_of([text.encode()]))
        assert pii.spans(text, True) == ([], []), text


def test_pii_table(spark, docs, empty):
    df = spark.createDataFrame([(1, "a@b.cc é x@y.zz 10.0.0.1"), (2, None), (3, ""), (None, "q [at] r.ss"), (1, "a@b.cc")], "doc_id long, text string")
    found = pii.find(df)
    got = [[(s["kind"], s["start"], s["end"]) for s in r["plain_spans"] + r["added_spans"]] for r in found.collect()]
    assert got == [[("email", 0, 6), ("email", 9, 15), ("ip", 16, 24)], [], [], [("email", 0, 11)], [("email", 0, 6)]]
    assert [r["text"] for r in pii.redact(found).collect()] == ["[EMAIL] é [EMAIL] [IP]", None, "", "[EMAIL]", "[EMAIL]"]
    assert pii.mask(df).collect() == pii.redact(found).select("doc_id", "text").collect()
    assert pii.find(docs).count() == docs.count() and pii.find(empty).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(20000).select(F.xxhash64("id").alias("h"))
    for share in (3, 2000):
        listed = spark.range(20000).filter(F.col("id") % share == 0).select(F.xxhash64("id").alias("h"))
        cascade = urls.build_cascade(universe, listed)
        rows = spark.range(20000).select("id", F.xxhash64("id").alias("h")).toPandas()
        assert (cascade.lists(rows["h"].to_numpy().view(np.uint64)) == (rows["id"] % share == 0)).all()
    assert len(cascade.levels) >= 1
    assert not urls.build_cascade(universe, universe.limit(0)).lists(rows["h"].to_numpy().view(np.uint64)).any()


def test_url_rules(spark):
    cases = {
        "http://a.example.net/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://a.example.net/de/1?x=/en/": ("a.example.net", "/de/1", "net/", "block"),
        "https://EXAMPLE.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "https://example.com/de": ("example.com", "/de", None, "allow"),
        "x://badexample.com/de/1": ("badexample.com", "/de/1", None, "allow"),
        "x://b.org/fr/": ("b.org", "/fr/", "org/fr/", "allow"),
        "x://b.org?/fr/": ("b.org", "", None, "allow"),
        "x://net": ("net", "", None, "allow"),
        "x://net/": ("net", "/", "net/", "block"),
        "x://w.casino-win.example.com#a": ("w.casino-win.example.com", "", None, "block"),
        "x://w.casino-win.example.org/": ("w.casino-win.example.org", "/", None, "allow"),
        "x://w.casino-win.example.com/de/x": ("w.casino-win.example.com", "/de/x", "example.com/de/", "block"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "x:///en/": ("", "/en/", None, "allow"),
        "a://b://c.net/": ("b:", "//c.net/", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "z", "z") for i, u in enumerate(cases)], "page_id long, url string, rule string, _keys string")
    judged = urls.judge(pages, queries.URL_RULES, queries.BLOCKED_HOSTS)
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judged.collect()}
    assert got == cases
    assert urls.judge(pages.limit(0), queries.URL_RULES, queries.BLOCKED_HOSTS).count() == 0


@pytest.mark.parametrize("n_ranges", [1, 3, 40])
def test_fingerprints_see_the_next_document(docs, rows, n_ranges):
    got = {r["doc_id"]: r for r in fingerprint.with_next(docs, n_ranges=n_ranges).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        changed = fingerprint.edited(t, following)
        prints = fingerprint.fingerprints(block_of([x.encode() for x in (t, changed, following)]))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert [r["fingerprint"], r["edited_fingerprint"]] == prints[:2]
        assert (r["near_edited"], r["near_next"]) == (fingerprint.containment(*prints[:2]), fingerprint.containment(prints[0], prints[2]))


def test_fingerprints_resist_shifts(spark, empty):
    rng = random.Random(5)
    text = " ".join(make_words(rng, 600))
    prints = fingerprint.fingerprints(block_of([text.encode(), ("some words before " + text).encode(), " ".join(make_words(rng, 600)).encode(), b"", text.encode()]))
    assert fingerprint.containment(prints[0], prints[1]) > 0.95
    assert fingerprint.containment(prints[0], prints[2]) < 0.05
    assert prints[0] == prints[4] and prints[3] == "" and fingerprint.containment("", "") == 1.0 and fingerprint.containment("", prints[0]) == 0.0
    assert fingerprint.with_next(empty).count() == 0
    df = spark.createDataFrame([(1, "b" * 50), (1, "a" * 50), (None, None), (None, "c")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["n_chars"]) for r in fingerprint.with_next(df, n_ranges=4).collect()) == [(-1, 0), (-1, 1), (1, 50), (1, 50)]


def brute_scores(items, text, threshold, stride):
    """Best plain BM25 share of every item over the passages, by definition."""
    split = lambda t: re.findall(rb"[a-z0-9\x80-\xff]+", t.lower().encode())
    bags = [split(t) for t in items]
    n, mean = len(bags), sum(map(len, bags)) / len(bags)
    df = {w: sum(w in b for b in bags) for b in bags for w in b}
    value = lambda b, w: np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * b.count(w) * 2.2 / (b.count(w) + 1.2 * (0.25 + 0.75 * len(b) / mean))
    full = [sum(value(b, w) for w in set(b)) for b in bags]
    w = split(text)
    out = {}
    for s in range(0, max(1, len(w) - stride), stride):
        there = set(w[s : s + 2 * stride])
        for k, b in enumerate(bags):
            v = sum(value(b, x) for x in set(b) & there) / full[k]
            if v >= threshold:
                out[k] = max(out.get(k, 0), v)
    return out


def test_retrieval_equals_brute_force(spark):
    rng = random.Random(6)
    items = [" ".join(make_words(rng, rng.randint(5, 40), 60)) for _ in range(50)]
    texts = [" ".join(make_words(rng, 300, 60)) for _ in range(8)]
    for k in range(8):
        part = items[k].split()
        texts[k] = texts[k][:400] + " " + " ".join(w for w in part if rng.random() < 0.75) + " " + texts[k][400:]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontaminate.find(df, bench, threshold=0.3, min_overlap=0.0)
    got = {(r["doc_id"], r["item_id"]): round(r["score"], 6) for r in found.collect()}
    want = {(d, k): round(float(v), 6) for d, t in enumerate(texts) for k, v in brute_scores(items, t, 0.3, 64).items()}
    assert got == want and want


def test_contaminated_documents(spark, empty, monkeypatch):
    rng = random.Random(9)
    items = [" ".join(make_words(rng, 30)) + ". " + " ".join(make_words(rng, 8)) + "." for _ in range(20)]
    clean = [" ".join(make_words(rng, 400)) for _ in range(20)]
    dirty = [c[:700] + " " + (t.upper() if k % 2 else t) + " " + c[700:] for k, (c, t) in enumerate(zip(clean, items, strict=True))]
    question_only = clean[3][:300] + " " + items[3].split(". ")[0] + " " + clean[3][300:]
    docs = spark.createDataFrame([*enumerate(clean), *((100 + k, t) for k, t in enumerate(dirty)), (500, question_only), (501, None), (502, "")], "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (77, None), (78, ""), (4, items[4])], "item_id long, text string")
    want = sorted([(100 + k, k) for k in range(20)] + [(104, 4)])
    for postings in (1_000_000, 100):
        monkeypatch.setattr(decontaminate, "SHARD_TERMS", postings)
        got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, bench).collect())
        assert got == want
    assert decontaminate.find(empty, bench).count() == 0
    assert decontaminate.find(docs, bench.limit(0)).count() == 0


def test_toxicity_sees_through_disguise(spark, empty):
    rng = random.Random(11)
    plain = lambda n: " ".join(rng.choice(["the", "river", "stone", "idea", "round", "street", "light", "moon", "corner", "paper", "slow", "tree"]) for _ in range(n))
    bad = ["grumbok", "snarlit", "dreckop"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = plain(60).split()
        if toxic:
            words[10] = rng.choice(bad)
            words[30] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (3, None), (0, 1), (99999, 1)]
    tests = [(1000, plain(30) + " grumb0k " + plain(20)), (1001, plain(30) + " s n a r l i t " + plain(20)), (1002, plain(20) + " dreeeckop " + plain(9)),
             (1003, plain(50)), (1004, None), (1005, ""), (1006, plain(20) + " d-r-e-c-k-o-p " + plain(9)), (1000, plain(5)), (None, "x " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    label_table = spark.createDataFrame(labels, "doc_id long, toxic int")
    every = docs.union(spark.createDataFrame(tests, "doc_id long, text string"))
    model = toxicity.train(every, docs, label_table)
    scored = toxicity.score(spark.createDataFrame(tests, "doc_id long, text string").coalesce(1), model).collect()
    p = [r["toxicity"] for r in scored]
    assert all(0 <= x <= 1 for x in p)
    assert min(p[0], p[1], p[2], p[6]) > 0.5 > 0.3 > max(p[3], p[4], p[5], p[7], p[8])
    assert "grumbok" in scored[0]["restored_text"] and "snarlit" in scored[1]["restored_text"] and scored[3]["restored_text"] == tests[3][1]
    blank = toxicity.train(empty, empty, label_table)
    assert {r["toxicity"] for r in toxicity.score(docs, blank).collect()} == {0.5}
    assert toxicity.score(empty, model).count() == 0
