"""Ranked search over bag classes, periodic runs and byte-level BPE against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from shelfrank.llm import bag_search, bpe, queries, runs

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id bigint, text string, word string, n string, bag string, term string, class string"


def some_docs(texts):
    return [(i, t, "x", "x", None, "x", "x") for i, t in texts]


@pytest.fixture(scope="module")
def edge_rows():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(60)]
    body = " ".join(rng.choices(words, k=200))
    unit = " ".join(rng.choices(words, k=9))
    return [
        (1, None), (2, ""), (2, ""), (3, "one"), (None, body), (None, body), (4, body),
        (5, body.upper()), (6, body + " One ONE é É"), (7, "  \n\t ... !?"),
        (8, " ".join(rng.choices(words, k=30_000))), (9, " ".join([unit] * 40)),
        (10, "é ñ 日本語 <|endoftext|> it's WE'LL 123456 \r\n\x0b\x85  x"),
        (11, "ha " * 500), (12, "lone " * 23), (13, "lone " * 24), (7, "ha" * 3000 + " " * 700),
    ]


@pytest.fixture(scope="module")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(some_docs(edge_rows), DOCS)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


# --- ranked search


def terms_of(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in found]


def brute_search(docs, items, k=20):
    bags = [(i, len(terms_of(t)), Counter(terms_of(t))) for i, t in docs]
    bags = [b for b in bags if b[1]]
    n, total = len(bags), sum(b[1] for b in bags)
    df = Counter(w for _, _, bag in bags for w in bag)
    wanted = {}
    for item, text in dict.fromkeys(items):
        if item is not None:
            wanted.setdefault(item, Counter()).update(terms_of(text))
    out = []
    for item, query in wanted.items():
        scored = []
        for doc, size, bag in bags:
            m = 100 - 25 + (25 * size * n) // total
            score = sum(
                r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))
                * ((10**9 * bag[w]) // (1000 * bag[w] + 12 * m))
                for w, r in query.items() if w in bag
            )
            if score > 0:
                scored.append((-score, doc is None, doc))
        scored.sort(key=lambda s: s[:2] + ((s[2],) if s[2] is not None else ()))
        out += [(item, r + 1, s[2], -s[0]) for r, s in enumerate(scored[:k])]
    return sorted(out, key=repr)


def searched(docs, items, **options):
    found = bag_search.search(docs, items, **options).collect()
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in found], key=repr)


@pytest.mark.parametrize("slice_terms", [7, 500_000])
def test_search_equals_brute_force(spark, edge_rows, edge_docs, slice_terms):
    body = edge_rows[4][1].split(" ")
    items = [
        (1, " ".join(body[:40])), (1, "ONE one"), (1, "ONE one"), (2, body[0] * 2), (3, None), (4, "?"),
        (5, " ".join(body[10:20]).upper() + " é É"), (None, body[0]), (6, body[3] + " " + body[3]),
    ]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = searched(edge_docs, bench, slice_terms=slice_terms)
    assert got == brute_search(edge_rows, items)
    assert searched(edge_docs, bench, slice_terms=slice_terms, k=2) == brute_search(edge_rows, items, 2)


def test_classes_are_scored_once_and_expanded_by_id(spark):
    """Hundreds of copies and of ties: members come by ascending id across classes."""
    rng = random.Random(5)
    rows = [(rng.randrange(10_000), t) for t in ["a b"] * 300 + ["b a"] * 300 + ["a c"] * 300 + ["z y"]]
    docs = spark.createDataFrame(some_docs(rows), DOCS).repartition(5)
    items = [(1, "a"), (2, "b c"), (3, "z")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert searched(docs, bench) == brute_search(rows, items)
    part = spark.sparkContext.broadcast(bag_search.Slice(bag_search.item_terms(bench).toPandas()))
    bags = bag_search.bags(docs, part)
    assert bags.count() == 901 and bags.select("bag").distinct().count() == 3


def test_search_in_small_chunks_of_classes(spark, edge_rows, edge_docs, monkeypatch):
    items = [(i, t) for i, t in enumerate(t for _, t in edge_rows if t and len(t) < 5000)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_search(edge_rows, items)
    assert searched(edge_docs, bench) == want
    monkeypatch.setattr(bag_search, "CELLS", 40)
    own = bag_search.Slice(bag_search.item_terms(bench).toPandas())
    best = bag_search.Best(len(own.ids), 2)
    rng = np.random.default_rng(0)
    scores = rng.integers(0, 9, (50, len(own.ids)))
    facts = np.column_stack([np.arange(50), np.arange(50), np.full(50, 75), rng.permutation(50)])
    for a in range(0, 50, 7):
        best.add(scores[a : a + 7], facts[a : a + 7])
    for item in range(len(own.ids)):
        order = sorted(range(50), key=lambda c: (-scores[c, item], facts[c, 3]))[:2]
        assert best.rows[best.rows[:, 0] == item, 1].tolist() == [c for c in order if scores[c, item]]


def test_search_of_empty_tables(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    one = spark.createDataFrame([(1, "one")], "item_id bigint, text string")
    blank = spark.createDataFrame(some_docs([(1, None), (2, "?")]), DOCS)
    for docs, bench in ((no_docs, one), (edge_docs, none), (blank, one)):
        found = bag_search.search(docs, bench)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_search_keeps_text_ids(spark, edge_docs):
    bench = spark.createDataFrame([("q", "one")], "item_id string, text string")
    assert {r[0] for r in searched(edge_docs, bench)} == {"q"}


# --- periodic runs


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            part = words[i : i + length]
            if j > i and length >= max(24, 3 * q):
                if not any(part[: length - p] == part[p:] for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_digest(doc, text, plant=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc).encode())
    if plant and doc is not None and h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in drop)
    milli = 1000 * best[1] // best[2] if found else None
    shas = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
    return (doc, len(found), *best, milli, *shas)


def test_runs_of_small_alphabets_equal_brute_force():
    rng = random.Random(11)
    lists = []
    for _ in range(800):
        n, letters = rng.randint(0, 150), rng.choice(["a", "ab", "abc", "abcdefgh"])
        words = [rng.choice(letters).encode() for _ in range(n)]
        if n and rng.random() < 0.7:
            a, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            if rng.random() < 0.5:
                words[rng.randrange(n)] = b"z"
        lists.append(words)
    got = runs.find_runs(lists)
    assert got == [brute_runs(w) for w in lists]
    assert sum(map(len, got)) > 200 and max(r[2] for x in got for r in x) > 30


def test_runs_digest_equals_brute_force(spark, edge_rows, edge_docs, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    small = [d for d in docs if len((d[1] or "").split()) < 700]
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in small)
    found = {r.doc_id: tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    assert len(found) == len(docs)
    for doc, text in small:
        assert found[doc] == brute_digest(doc, text)
    short = edge_docs.where("doc_id is null or doc_id <> 8")
    got = queries.runs_digest(runs.periodic_runs(short)).collect()
    want = [brute_digest(i, t, plant=False) for i, t in edge_rows if i != 8]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_runs_of_long_texts_and_edges(spark, edge_docs, no_docs):
    found = {r.doc_id: r for r in runs.periodic_runs(edge_docs.where("doc_id in (8, 11, 12, 13)")).collect()}
    assert found[8].n_words == 30_000 and found[8].runs == []
    assert [tuple(r) for r in found[11].runs] == [(0, 500, 1)] and found[11].text == "ha"
    assert found[12].runs == [] and [tuple(r) for r in found[13].runs] == [(0, 24, 1)]
    assert runs.periodic_runs(no_docs).count() == 0
    unit = [f"w{i}".encode() for i in range(70_000)]
    assert runs.find_runs([unit * 3 + [b"end"]]) == [[(0, 210_000, 70_000)]]


def test_splitting_leaves_only_words_that_can_join_a_run():
    rng = random.Random(2)
    words = [f"u{i}".encode() for i in range(500)]
    words[200:260] = [b"a", b"b", b"c"] * 20
    words[300:340] = [b"r"] * 40
    hashes, _ = runs.hashed_words([b" ".join(words)], runs.IS_WORD, lower=False)
    left = runs.surviving(hashes, np.zeros(500, np.int64)).tolist()
    assert left == [*range(200, 260), *range(300, 340)]
    assert rng and runs.strongest([(5, 24, 8), (1, 24, 8), (0, 25, 9)]) == (1, 24, 8)


# --- byte-level BPE


@pytest.fixture(scope="module")
def own_tiktoken():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}
    )


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(RANKS, public_tokenizers.PATTERN)


def test_bpe_equals_the_library(coder, own_tiktoken):
    rng = random.Random(4)
    texts = ["".join(rng.choices(a, k=rng.randint(0, 300))) for a in ("het", "abcdehst n'", "aA1 .\n") * 60]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)]))
                      for _ in range(200)) for _ in range(50)]
    texts += ["he" * 5000, "a" * 10_001, " " * 3000 + "x", "".join(rng.choices("abcdefghij", k=3000))]
    got = coder.encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own_tiktoken.encode_ordinary(text)
    assert coder.decode(got) == [t.encode() for t in texts]


def test_bpe_of_odd_ranks_equals_the_library(spark):
    """Ranks not made by training, where contractions make pairs of lower rank than their own."""
    rng = random.Random(8)
    for seed in range(12):
        bodies = [bytes([b]) for b in range(256)]
        pool = ["".join(rng.choices("ab", k=rng.randint(2, 6))).encode() for _ in range(25)]
        pool += ["".join(rng.choices("abc", k=rng.randint(2, 4))).encode() for _ in range(25)]
        ranks = {b: i for i, b in enumerate(dict.fromkeys(bodies + pool))}
        library = tiktoken.Encoding("odd", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
        own = bpe.Coder.__new__(bpe.Coder)
        own.load(ranks, r"\S+|\s+")
        texts = ["".join(rng.choices("abc", k=rng.choice([5, 30, 63, 65, 200]))) for _ in range(40)]
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), (seed, text)


def test_bpe_goes_on_over_queries_and_caches(own_tiktoken, monkeypatch):
    for name, value in (("STEPS", 2), ("WORD_BYTES", 50), ("CACHE_WORDS", 3), ("DECODE_IDS", 7), ("SHORT", 8)):
        monkeypatch.setattr(bpe, name, value)
    own = bpe.Coder(RANKS, public_tokenizers.PATTERN)
    texts = ["herouththeheron therondingly unbelievable thereof", "x herouththeheron", "", "abc" * 30]
    for _ in range(2):
        ids = own.encode(texts)
        assert [np.frombuffer(i, "<u4").tolist() for i in ids] == [own_tiktoken.encode_ordinary(t) for t in texts]
        assert own.decode(ids) == [t.encode() for t in texts]


def test_bpe_decodes_without_queries(monkeypatch):
    own = bpe.Coder(RANKS, public_tokenizers.PATTERN)
    texts = ["one two\n", "", "é" * 30, "\x00 ok"]
    ids = own.encode(texts)
    own.db.close()
    monkeypatch.setattr(bpe, "DECODE_IDS", 3)
    assert own.decode(ids) == [t.encode() for t in texts]
    unknown = np.array([1 << 20], "<u4").tobytes()
    assert own.decode([unknown + ids[0], unknown]) == [b"one two\n", b""]


def test_bpe_tables(spark, edge_rows, edge_docs, no_docs, own_tiktoken, sf_dir):
    coded = bpe.encode(edge_docs, RANKS, public_tokenizers.PATTERN)
    got = bpe.decode(coded, RANKS, public_tokenizers.PATTERN).collect()
    want = [(i, own_tiktoken.encode_ordinary(t or ""), (t or "").encode()) for i, t in edge_rows]
    rows = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in got]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)
    assert bpe.decode(bpe.encode(no_docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).count() == 0
    found = queries.QUERIES["op13_byte_bpe"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(found) == len(texts)
    for r in found:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        ids = np.array(own_tiktoken.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())


def test_search_equals_its_sql(spark, duck, sf_dir):
    got = queries.QUERIES["op11_ranked_search"](spark, sf_dir).collect()
    want = duck.execute(queries.ORACLES["op11_ranked_search"]).fetchall()
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == sorted(want)


# --- keys of rows


def test_row_keys_tell_nulls_apart_and_take_maps(spark):
    from shelfrank.llm import decontam, simhash
    from shelfrank.llm.common import row_key

    rows = [
        (1, "same text", None, "x", {"k": None}, [None, 1]),
        (1, "same text", "x", None, {"k": None}, [None, 1]),
        (1, "same text", "x", None, {}, [None, 1]),
        (1, "same text", "x", None, None, [1, None]),
        (1, "same text", "x", None, None, [1]),
        (1, "same text", "x", None, None, None),
    ]
    schema = "doc_id bigint, text string, a string, `b.c` string, m map<string,string>, v array<int>"
    docs = spark.createDataFrame(rows + rows[:2], schema)
    assert docs.select(row_key(docs).alias("key")).distinct().count() == len(rows)
    # All rows have one text: one stays, with all its columns. Nothing here is contaminated.
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == 1
    bench = spark.createDataFrame([(1, "other words")], "item_id bigint, text string")
    assert decontam.keep_uncontaminated(docs, bench).count() == len(rows) + 2
