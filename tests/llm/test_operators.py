"""Corpus operators against brute force on small tables, and their defined edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfrank.llm import (
    decontam,
    hnsw,
    id_coder,
    langid,
    line_dedup,
    packing,
    passages,
    queries,
    simhash,
    token_files,
    toxicity,
    warc,
)
from shelfrank.llm.common import components, new_path, pieces_of
from shelfrank.llm.tokens import Encoder

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars int, row string, key string"


@pytest.fixture(scope="module")
def edge_docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like inner ones."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    body = " ".join(rng.choices(words, k=300))
    rows = [
        (1, None, "en", "s", 0, "x", None),
        (2, "", "en", "s", 0, "x", "k"),
        (2, "", "en", "s", 0, "x", "k"),
        (3, "one", None, None, 3, None, "k"),
        (None, "no id here", "fr", "s", 9, "x", "k"),
        (4, " ".join(rng.choices(words, k=30_000)), "en", "t", 9, "x", "k"),
        (5, body, "de", "t", 9, "x", "k"),
        (6, body, "de", "t", 9, "x", "k"),
        (7, body.replace(words[0], "changed", 1) + "\nline", "de", "t", 9, "x", "k"),
        (8, "  \n \t ", "de", "t", 9, "x", "k"),
        (9, "é ñ 日本語 <|endoftext|> Á", "es", "t", 9, "x", "k"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- decontamination


def words_of(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_contamination(docs, items, size=13):
    grams = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1) if w else []:
            grams[tuple(w[i : i + n])].add(str(item))
    sizes = {len(g) for g in grams}
    out = []
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit |= set(range(i, i + n))
                    found |= grams[g]
        out.append((doc, len(w), len(hit), sorted(found)))
    return out


BENCH = "item_id bigint, text string"


@pytest.mark.parametrize("limit", [1, 200_000])
def test_decontamination_is_exact(spark, edge_docs, limit):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    long = rows[5][1].split(" ")
    items = [
        (1, " ".join(long[100:130]).upper()),
        (2, "ONE"),
        (3, None),
        (4, "!!"),
        (5, " ".join(long[29_980:])),
        (5, " ".join(long[29_980:])),
        (6, "never seen words in here"),
        (7, " ".join(rows[6][1].split(" ")[:13])),
    ]
    bench = spark.createDataFrame(items, BENCH)
    index = decontam.build_index(edge_docs)
    found = decontam.search(index, bench, slice_windows=limit).collect()
    got = sorted(((r.doc, r.n_words, r.n_hit, list(r["items"])) for r in found), key=repr)
    assert got == sorted(brute_contamination(rows, items), key=repr)
    for r in found:
        assert sum(r.lengths) == r.n_hit


def test_proximity(spark):
    docs = spark.createDataFrame(
        [(1, "x alpha y beta z gamma"), (2, "alpha beta"), (3, "gamma " + "q " * 9 + "beta alpha"), (4, "gamma beta alpha")],
        "doc_id bigint, text string",
    )
    bench = spark.createDataFrame([(1, "alpha beta gamma")], BENCH)
    found = decontam.search(decontam.build_index(docs), bench, slack=2).collect()
    spans = {r.doc: list(zip(r.starts, r.lengths, strict=True)) for r in found}
    assert spans == {1: [(1, 5)], 2: [], 3: [], 4: [(0, 3)]}


def test_decontamination_of_nothing(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([], BENCH)
    assert decontam.contamination(no_docs, bench).count() == 0
    assert decontam.contamination(edge_docs, bench).where("n_hit > 0 or contaminated").count() == 0
    kept = decontam.keep_uncontaminated(edge_docs, bench)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()


# --- nearest neighbours


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, key string")


def test_neighbours_of_small_tables_are_exact(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 8)).astype(np.float32)
    v[40:60] = v[40]  # ties
    rows = [(i, x.tolist(), None, "k") for i, x in enumerate(v)]
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7]
    rows += [(100 + 20 * i, x, None, "k") for i, x in enumerate(odd)]
    rows += [(0, v[0].tolist(), None, "k"), (None, v[1].tolist(), None, "k"), (300, [1.0, 2.0], 1, "k")]
    found = hnsw.nearest(vectors(spark, rows), F.col("id") % 20 == 0, k=20).collect()
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {0, 20, 40, 60, 80}
    for q, hits in got.items():
        scores = np.cumsum(v.astype(float) * v[q].astype(float), axis=1)[:, -1]
        want = sorted((-s, i) for i, s in enumerate(scores) if i != q)[:20]
        assert [i for i, _ in hits] == [i for _, i in want]
        assert [s for _, s in hits] == [-s for s, _ in want]


def test_neighbours_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = hnsw.nearest(rows, F.col("id") % 20 == 0).toPandas()
    pdf = rows.toPandas().sort_values("vec_id")
    v, ids = np.stack(pdf.embedding).astype(float), pdf.vec_id.to_numpy()
    hits = []
    for q, part in found.groupby("query_id"):
        scores = v @ v[ids == q][0]
        scores[ids == q] = -np.inf
        hits.append(len(set(ids[np.lexsort((ids, -scores))[:20]]) & set(part.vec_id)) / 20)
    assert np.mean(hits) >= 0.95 and len(hits) == (ids % 20 == 0).sum()


def test_graph_reaches_all_nodes():
    v = np.vstack([np.full((60, 4), 1.0) + np.arange(60)[:, None] * 1e-6, -np.eye(4)])
    graph = hnsw.Graph(hnsw.lifted(v), hnsw.levels_of(v)).build()
    assert sorted(graph.search(np.append(v[0], 0).astype(np.float32), 64)) == list(range(64))


def test_walks_side_by_side_find_what_single_walks_find():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(1500, 16))
    graph = hnsw.Graph(hnsw.lifted(v), hnsw.levels_of(v)).build()
    q = np.hstack([v[:40], np.zeros((40, 1))]).astype(np.float32)
    together = graph.search_all(q, 60)
    for one, row in zip(q, together, strict=True):
        assert graph.search(one, 60) == row[row >= 0].tolist()
    exact = np.argsort(-(v[:40] @ v.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(exact, together, strict=True)]) >= 0.95
    # Links lead to other nodes, and to each but once (the ring's may be among them).
    low = [row[row >= 0].tolist() for row in graph.low[:, 1:]]
    assert all(i not in row and len(set(row)) == len(row) for i, row in enumerate(low))


def test_queries_read_all_shards_and_copy_none(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(600, 8)).astype(np.float32)
    rows = vectors(spark, [(i, x.tolist(), None, "k") for i, x in enumerate(v)])
    every = hnsw.usable(rows, "vec_id", "embedding").drop("id")
    index = hnsw.build_index(every, shard_rows=100)
    assert index.count() == 6
    hits = hnsw.shard_hits(index, every.limit(50), 20, 100)
    # Per query one merged list instead of one per shard.
    assert hits.groupBy("query").count().where("count <> 20").count() == 0
    known = {r.key: np.array(r.vec) for r in every.collect()}
    keys = list(known)
    matrix = np.stack(list(known.values()))
    found = defaultdict(set)
    for r in hits.collect():
        found[r["query"]].add(r.key)
    recall = [len(got & {keys[i] for i in np.argsort(-(matrix @ known[q]))[:20]}) / 20 for q, got in found.items()]
    assert len(found) == 50 and np.mean(recall) >= 0.95


def test_no_neighbours(spark):
    assert hnsw.nearest(vectors(spark, []), F.col("id") % 20 == 0).count() == 0
    alone = vectors(spark, [(20, [1.0, 0.0], 1, "k")])
    assert hnsw.nearest(alone, F.col("id") % 20 == 0).count() == 0


# --- archives

PAGES = "page_id bigint, url string, html string, shard string"


def test_warc_round_trip(spark):
    same = "é" * 600
    rows = [(i, f"http://a/{i}", f"<p>{i}</p>" * i, "x") for i in range(40)]
    rows += [(50, "u\r\nX: y", same, "x"), (51, None, same, "x"), (49, "", same, "x"), (49, "", same, "x")]
    rows += [(60, "u", "small", "x"), (61, "u", "small", "x"), (62, "u", None, "x"), (None, "u", same, "x")]
    pages = spark.createDataFrame(rows, PAGES)
    folder = new_path(spark, "warc-test")
    manifest = warc.write_warc(pages, folder, shard_bytes=2000, roll_bytes=600).collect()
    assert len(manifest) > 5
    found = warc.read_warc(spark, folder).collect()
    assert len(found) == len(rows)
    for r in found:
        html = next(h for i, _, h, _ in rows if i == r.page_id) or ""
        assert r.payload_bytes == len(html.encode())
        assert r.payload_digest == hashlib.sha1(html.encode()).hexdigest()
        revisit = html == same and r.page_id != 51
        assert (r.record_type, r.refers_to) == (("revisit", 51) if revisit else ("response", None))
        assert r.payload is None if revisit else (r.payload or b"") == html.encode()
    again = new_path(spark, "warc-test")
    other = warc.write_warc(pages.repartition(5), again, shard_bytes=2000, roll_bytes=600).collect()
    assert sorted(manifest) == sorted(other)  # names, sizes and digests of all files


def test_warc_of_nothing(spark):
    folder = new_path(spark, "warc-test")
    warc.write_warc(spark.createDataFrame([], PAGES), folder)
    assert warc.read_warc(spark, folder).count() == 0


def test_shard_boundaries_follow_weights(spark):
    rows = [(i, 1) for i in range(1000)] + [(5000, 1)] * 300 + [(10**12, 1)]
    bounds = pieces_of(spark.createDataFrame(rows, "k bigint, w bigint"), "k", "w", 100, grid=8)
    keys = np.searchsorted(bounds, [k for k, _ in rows], side="right")
    sizes = np.bincount(keys)
    assert max(np.delete(sizes, sizes.argmax())) <= 200 and sizes.max() <= 301


# --- tokens and packing


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_cached_ids_are_the_tokenizers(spark, sf_dir, path):
    texts = [r.text for r in documents(spark, sf_dir).limit(60).collect()]
    texts += ["", " ", "a  b", " a", "a ", "\n\n a . b\n", "it's, it's. x\t y  \n z", "a.\nB", "a\n"]
    texts += ["<|endoftext|> a <|endoftext|>, b", "é a ́b . ", "A  b　", "\x00 \x1c x", "ß İ ǅ 12 34.5"]
    tokenizer = Tokenizer.from_file(path)
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    encoder = Encoder(path)
    assert encoder.encode(texts) == want
    assert encoder.encode(texts[::-1])[::-1] == want


@pytest.mark.parametrize(
    "ids",
    [[7], [0] * 9000, list(range(9000)), [50256] * 8191 + [0, 1], np.random.default_rng(1).integers(0, 65536, 20_000)],
)
def test_coder_round_trip(ids):
    ids = np.array(ids, np.uint32)
    blocks = [ids[i : i + 8192] for i in range(0, len(ids), 8192)]
    coded = id_coder.encode(blocks)
    assert all((a == b).all() for a, b in zip(id_coder.decode(coded), blocks, strict=True))
    assert (id_coder.decode(coded[-1:])[0] == blocks[-1]).all()  # blocks are independent


def test_coder_finds_damage(spark, sf_dir):
    ids = np.array(list(range(300)) * 4, np.uint32)
    block = bytearray(id_coder.encode([ids])[0])
    assert len(block) < 2 * len(ids)
    block[-40] ^= 4
    with pytest.raises(ValueError):
        id_coder.decode([bytes(block)])


def test_token_files_round_trip(spark, edge_docs, no_docs):
    folder = new_path(spark, "tokens-test")
    token_files.write_tokens(edge_docs, folder, BYTE_BPE, shard_bytes=3000)
    found = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    rows = sorted(edge_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert len(found) == len(rows)
    start = 0
    for r, row in zip(found, rows, strict=True):
        ids = [*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens) == (row.doc_id, start, len(ids))
        assert zlib.crc32(r.ids) == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    folder = new_path(spark, "tokens-test")
    token_files.write_tokens(no_docs, folder, BYTE_BPE)
    assert token_files.read_tokens(spark, folder).count() == 0


def test_packing_is_complete_and_tight(spark, edge_docs, no_docs):
    pieces = packing.packed_sequences(edge_docs, WORD_BPE, 64).collect()
    tokenizer = Tokenizer.from_file(WORD_BPE)
    want = sorted(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in edge_docs.collect())
    assert sum(r.length for r in pieces) == sum(want)
    assert sum(r.piece == 0 for r in pieces) == len(want)
    sequences = defaultdict(list)
    for r in pieces:
        assert len(r.ids) == 4 * r.length and r.start == 64 * r.piece
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 64
    assert packing.packed_sequences(no_docs, WORD_BPE).count() == 0


def least_bins(sizes, room):
    """The least number of bins, by trying every bin for every size."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def place(i, fills):
        nonlocal best
        if len(fills) >= best:
            return
        if i == len(sizes):
            best = len(fills)
            return
        for b in {f: b for b, f in enumerate(fills) if f + sizes[i] <= room}.values():
            place(i + 1, [f + sizes[i] * (c == b) for c, f in enumerate(fills)])
        place(i + 1, [*fills, sizes[i]])

    place(0, [])
    return best


def test_packing_against_the_least_number_of_bins():
    rng = random.Random(3)
    extra = []
    for _ in range(300):
        sizes = [rng.randint(1, 19) for _ in range(rng.randint(1, 11))]
        bins = packing.pack(sizes, 20)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 20 for b in bins)
        extra.append(len(bins) - least_bins(sizes, 20))
    assert min(extra) == 0 and max(extra) <= 1 and sum(extra) <= 6


def test_documents_fill_their_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = packing.packed_sequences(docs, WORD_BPE)
    total, found = pieces.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert found <= math.ceil(total / packing.LENGTH) + 1


def test_local_search_raises_fill():
    sizes = [6, 5, 4, 4, 3, 2] * 30
    bins = [[i] for i in range(len(sizes))]
    found = packing.Search(sizes, bins, 12).run(20)
    assert sorted(i for b in found for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 12 for b in found)
    assert len(found) <= 1.05 * math.ceil(sum(sizes) / 12)


def test_exchanges_of_the_search():
    one = packing.Search([7, 8, 5], [[0], [1, 2][:1]], 10)
    assert one.improve(0, 1) == 1 and one.fill == [8, 7]
    two = packing.Search([6, 3, 5, 4], [[0, 1], [2, 3]], 10)
    assert two.improve(0, 1) == 1 and two.fill == [10, 8]
    three = packing.Search([9, 4, 6], [[0], [1, 2]], 10)
    assert three.improve(0, 1) == 1 and sorted(three.fill) == [9, 10]


def test_groups_share_what_they_cannot_fill(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([700, 1100, 1400, 300])) for i in range(400)]
    pieces = spark.createDataFrame(rows, "uid bigint, length bigint")
    found = packing.assignments(pieces, 2048, group_pieces=50).collect()
    assert sorted(r.uid for r in found) == list(range(400))
    fill, size = defaultdict(int), dict(rows)
    for r in found:
        fill[r.sequence_id] += size[r.uid]
    assert max(fill.values()) <= 2048


# --- near-duplicates


def brute_fingerprint(text, n=3):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower) if x]
    grams = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    ids = list(prints)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and (prints[x] ^ prints[y]).bit_count() <= 3 and top(x) != top(y):
                a, b = sorted((top(x), top(y)))
                root[b] = a
    return {i: top(i) for i in ids}


def test_simhash_against_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir)
    prints = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    want = brute_classes(prints)
    found = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.fingerprint for r in found} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in found} == want


@pytest.mark.parametrize("tile", [2, 50])
def test_links_join_all_within_reach(spark, tile):
    rng = random.Random(11)
    seeds = [rng.getrandbits(64) for _ in range(8)] + [0, 2**64 - 1]
    values = set(seeds)
    for s in seeds:
        for _ in range(12):
            values.add(s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    rows = [(int(np.uint64(v).astype(np.int64)), i) for i, v in enumerate(sorted(values))]
    prints = spark.createDataFrame(rows, "fingerprint bigint, least bigint")
    pairs = simhash.links(prints.select("fingerprint"), tile_rows=tile)
    got = {r.node: r.root for r in components(pairs).collect()}
    want = brute_classes({i: v for i, v in enumerate(sorted(values))})
    classes = defaultdict(set)
    for f, i in rows:
        classes[got.get(f, f)].add(i)
    wanted = defaultdict(set)
    for i, r in want.items():
        wanted[r].add(i)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, wanted.values()))


def test_one_row_of_each_group_stays(spark, edge_docs, no_docs):
    kept = simhash.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is not None, x))
    # 1, 2, 2 and 8 have no words; 5 and 6 are copies and 7 may be near enough.
    assert [i for i in ids if i != 7] == [None, 1, 3, 4, 5, 9]
    assert simhash.one_of_each(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.near_duplicates(edge_docs).count() == edge_docs.count()


# --- passages


def test_compact_windows_against_brute_force():
    rng = np.random.default_rng(2)
    for top in (3, 1000):
        h = rng.integers(1, top + 1, 200).astype(np.uint32)
        h[[0, 77, 150, 199]] = 0
        for least in (1, 7, 10):
            want = set()
            for c in np.flatnonzero(h):
                left = c
                while left and h[left - 1] > h[c]:
                    left -= 1
                right = c
                while right + 1 < len(h) and h[right + 1] >= h[c]:
                    right += 1
                if right - left + 1 >= least:
                    want.add((left, c, right))
            assert set(zip(*(x.tolist() for x in passages.compact_windows(h, least)), strict=True)) == want


def test_shared_passages_are_found(spark):
    rng = random.Random(3)

    def text(n):
        return ["".join(rng.choices("abcdefghijk", k=6)) for _ in range(n)]

    shared, edited, whole = text(60), text(120), text(80)
    changed = edited[:60] + ["other"] + edited[61:]
    rows = [
        (1, text(90) + shared + text(20)),
        (2, shared + text(300)),
        (3, text(40) + shared),
        (4, text(30) + edited),
        (5, changed + text(70)),
        (6, whole),
        (7, whole),
        (8, text(400)),
        (9, text(200) + shared[:40]),
        (10, text(30)),
    ]
    docs = spark.createDataFrame(
        [(i, " ".join(t).capitalize(), "x") for i, t in rows] + [(11, None, "x"), (12, "", "x")],
        "doc_id bigint, text string, key string",
    )
    found = passages.near_passages(docs).collect()
    pairs = {(r.doc_id, r.other_id) for r in found}
    assert pairs == {(2, 1), (3, 1), (5, 4), (7, 6)}
    one = next(r for r in found if r.doc_id == 2)
    assert (one.start, one.other_start) == (0, 90) and 60 <= one.n_words <= 75
    assert all(r.similarity >= 0.8 for r in found)


def test_failed_links_try_the_next_representative(spark):
    rng = random.Random(9)

    def text(n):
        return ["".join(rng.choices("abcdefghijk", k=6)) for _ in range(n)]

    passage = text(70)
    rows = [(i, " ".join(text(20) + passage + text(20))) for i in range(5, 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = passages.near_passages(docs).collect()
    assert {(r.doc_id, r.other_id) for r in found} == {(6, 5), (7, 5), (8, 5)}


def test_chains_are_linked(spark):
    rows = []
    for k in (0, 21, 36, 37):
        rng = random.Random(k)

        def text(n, rng=rng):
            return ["".join(rng.choices("abcdefghijk", k=6)) for _ in range(n)]

        base = text(100)
        for i, at in enumerate([(20, 50), (), (35, 80)]):  # the first and the last are below 0.8
            edited = [f"other{k}" if n in at else w for n, w in enumerate(base)]
            rows.append((10 * k + i, " ".join(text(20) + edited + text(20))))
    found = passages.near_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    pairs = {(r.doc_id, r.other_id) for r in found}
    assert pairs == {p for k in (0, 21, 36, 37) for p in ((10 * k + 1, 10 * k), (10 * k + 2, 10 * k + 1))}


def linked_documents(found):
    """All pairs of documents that the rows of ``near_passages`` link."""
    classes = {}
    for r in found:
        if r.similarity == 1:
            classes.setdefault((r.other_id, r.other_start, r.other_words), {r.other_id}).add(r.doc_id)

    def alike(doc, start, words):
        inside = [m for (d, s, n), m in classes.items() if d == doc and s <= start and start + words <= s + n]
        return {doc}.union(*inside)

    pairs = {(x, y) for m in classes.values() for x in m for y in m if x > y}
    for r in found:
        for x in alike(r.doc_id, r.start, r.n_words):
            for y in alike(r.other_id, r.other_start, r.other_words):
                pairs |= {(max(x, y), min(x, y))} if x != y else set()
    return pairs


def test_no_link_of_two_texts_is_left_out(spark):
    rng = random.Random(29)

    def text(n):
        return ["".join(rng.choices("abcdefghijk", k=6)) for _ in range(n)]

    rows, want = [], set()

    def plant(passages):
        """Texts with a passage each; their pairs by the Jaccard similarity of whole passages."""
        ids = list(range(len(rows), len(rows) + len(passages)))
        rows.extend((i, " ".join(text(25) + p + text(25))) for i, p in zip(ids, passages, strict=True))
        sets = [{tuple(p[k : k + 5]) for k in range(len(p) - 4)} for p in passages]
        for x in range(len(ids)):
            for y in range(x):
                if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                    want.add((ids[x], ids[y]))

    for _ in range(4):
        base = text(98)
        edit = lambda *places: [f"other{len(rows)}" if n in places else w for n, w in enumerate(base)]  # noqa: E731, B023
        plant([edit(), edit(49), edit(30), edit()])
        plant([edit(48), edit(50), edit(49), edit(48)])
    base = text(60)
    plant([base] * 4)
    found = passages.near_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert want <= linked_documents(found)
    # One edit each in 98 words: later texts were linked to the first only.
    assert (2, 1) in want
    # The equal words and the passage around them are both rows.
    both = {(r.n_words >= 98, r.similarity == 1) for r in found if (r.doc_id, r.other_id) == (2, 0)}
    assert both >= {(False, True), (True, False)}


def test_passages_near_the_threshold(spark):
    rng = random.Random(17)

    def text(n):
        return ["".join(rng.choices("abcdefghijk", k=6)) for _ in range(n)]

    rows = []
    for k in range(90):  # one edit in 50 words, two in 98, three in 146: Jaccard 0.8 to 0.85
        edits = k % 3 + 1
        passage = text(2 + 48 * edits + 5 * (k % 2))
        edited = list(passage)
        for n in range(edits):
            edited[rng.randint(10, 40) + 48 * n] = "other"
        both = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (passage, edited)]
        assert 0.8 <= len(both[0] & both[1]) / len(both[0] | both[1]) < 0.85
        rows += [(2 * k, text(30) + passage + text(25)), (2 * k + 1, text(15) + edited + text(40))]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id bigint, text string")
    found = passages.near_passages(docs).collect()
    assert {(r.doc_id, r.other_id) for r in found} == {(2 * k + 1, 2 * k) for k in range(90)}
    assert all(r.similarity >= 0.8 for r in found)


def test_all_places_of_a_passage_are_found(spark):
    rng = random.Random(5)

    def text(n):
        return ["".join(rng.choices("abcdefghijk", k=6)) for _ in range(n)]

    passage = text(60)
    rows = [(1, text(20) + passage + text(20)), (2, passage + text(70) + passage + text(10))]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id bigint, text string")
    found = passages.near_passages(docs).collect()
    assert {(r.doc_id, r.start, r.other_id, r.other_start) for r in found} == {(2, 0, 1, 20), (2, 130, 1, 20)}
    run = [(i, " ".join(text(9) + ["again"] * 300 + text(9))) for i in (1, 2)]
    found = passages.near_passages(spark.createDataFrame(run, docs.schema)).collect()
    assert {(r.doc_id, r.other_id) for r in found} == {(2, 1)}


def test_passages_of_edges(spark, edge_docs, no_docs):
    assert passages.near_passages(no_docs).count() == 0
    found = passages.near_passages(edge_docs).collect()
    assert {(r.doc_id, r.other_id) for r in found} == {(6, 5), (7, 5)}


# --- lines


def test_boilerplate_lines(spark, edge_docs, no_docs):
    rows = [(i, f"menu\n own {i}\n\nmenu ", "a", "h") for i in range(10)]
    rows += [(20 + i, "copy", "a", "h") for i in range(10)] + [(40, "menu\nx", None, "h"), (41, None, "a", "h")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_lines string")
    found = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs).collect()}
    assert len(found) == len(rows)
    assert found[3].text == " own 3\n" and (found[3].n_lines, found[3].n_dropped) == (4, 2)
    assert found[25].text == "copy" and found[40].text == "menu\nx" and found[41].text is None
    assert line_dedup.drop_boilerplate(no_docs).count() == 0
    same = line_dedup.drop_boilerplate(edge_docs, counts=False)
    assert same.columns == edge_docs.columns
    assert sorted(map(repr, same.collect())) == sorted(map(repr, edge_docs.collect()))


# --- classifiers


def test_toxicity_learns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(docs, labels)
    assert 0 < len(model.features) < 200_000
    found = toxicity.score(docs, model, ["doc_id"]).join(labels, "doc_id").where(toxicity.held_out())
    pdf = found.toPandas()
    assert pdf.score.between(0, 1).all()
    said, toxic = pdf.score >= 0.3, pdf.toxic == 1
    # A model that never says toxic finds none; one that always does is mostly wrong.
    assert (said & toxic).sum() >= 0.55 * toxic.sum() > 0
    assert (said & toxic).sum() >= 0.8 * said.sum() > 0
    ranks = pdf.score.rank()
    auc = (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.8


def test_toxicity_equals_a_plain_ftrl(spark):
    """Weights of the fit against dictionaries, over all features and without pruning."""
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = (
        docs.join(labels.select("doc_id", "toxic"), "doc_id")
        .where(~toxicity.held_out() & F.col("toxic").isin(0, 1))
        .orderBy(F.xxhash64("doc_id"))
        .select("text", "toxic")
        .collect()
    )
    state = defaultdict(lambda: [0.0, 0.0])

    def weight(f):
        z, n = state[f]
        if abs(z) <= toxicity.L1:
            return 0.0
        return -(z - math.copysign(toxicity.L1, z)) / ((toxicity.BETA + math.sqrt(n)) / toxicity.ALPHA + toxicity.L2)

    texts = [(["bias", *toxicity.features([(r.text or "").encode()])[1].tolist()], r.toxic) for r in rows]
    for _ in range(toxicity.EPOCHS):
        for found, label in texts:
            w = {f: weight(f) for f in found}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for f in found:
                z, n = state[f]
                rate = (math.sqrt(n + g * g) - math.sqrt(n)) / toxicity.ALPHA
                state[f] = [z + g - rate * w[f], n + g * g]
    want = {f: weight(f) for f in state if weight(f)}
    assert model.bias == pytest.approx(want.pop("bias", 0.0), abs=1e-9)
    got = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    assert got.keys() == want.keys()
    assert all(got[f] == pytest.approx(want[f], abs=1e-9) for f in got)


def test_toxicity_of_edges(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(edge_docs, none)
    assert all(r.score < 1e-9 for r in toxicity.score(edge_docs, model, ["doc_id"]).collect())
    kept = toxicity.keep_clean(edge_docs, model)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()
    assert toxicity.keep_clean(no_docs, model).count() == 0
    odd = spark.createDataFrame(
        [(5, 1, 1), (5, 1, 0), (6, 0, 0), (7, 0, None), (None, 1, 1), (4, 0, 7)], none.schema
    )
    scores = toxicity.score(edge_docs, toxicity.fit(edge_docs, odd), ["doc_id"]).collect()
    assert len(scores) == edge_docs.count() and all(0 <= r.score <= 1 for r in scores)


def test_ftrl_follows_its_formula():
    state = toxicity.Ftrl(2)
    for _ in range(30):
        state.learn(np.array([0, 1]), 1.0)
        state.learn(np.array([1]), 0.0)
    w = state.weights()
    assert w[0] > 0 > w[1] or w[0] > w[1]
    assert toxicity.Ftrl(1).weights()[0] == 0


def test_language(spark, edge_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trees = langid.fit(docs)
    pdf = langid.identify(docs, trees).join(docs.select("doc_id", "lang"), "doc_id").where(toxicity.held_out()).toPandas()
    assert (pdf.lang_pred == pdf.lang).mean() > 0.97 and pdf.score.between(0, 1).all()
    found = {r.doc_id: r for r in langid.identify(edge_docs, trees).collect()}
    assert found[1].lang_pred == found[2].lang_pred == found[8].lang_pred == "und"
    assert langid.identify(no_docs, trees).count() == 0
    empty = langid.fit(no_docs)
    assert {r.lang_pred for r in langid.identify(edge_docs, empty).collect()} == {"und"}


def test_code_length_against_brute_force():
    texts = [b"abracadabra " * 40, b"abrabra cada " * 30]
    grams = []
    for n in range(1, langid.ORDER + 2):
        counts = defaultdict(int)
        for t in texts:
            t = b"\n" * langid.ORDER + t
            for i in range(len(t) - n + 1):
                counts[t[i : i + n]] += 1
        grams.append(dict(counts))
    seen = sorted({b for (b,) in grams[0]})
    symbol = np.zeros(256, np.int64)
    symbol[seen] = np.arange(1, len(seen) + 1)
    trees = langid.Trees(["x"], symbol, [langid.tree(grams, symbol, len(seen) + 1)])
    contexts = defaultdict(dict)
    for counts in grams:
        for g, n in counts.items():
            contexts[g[:-1]][g[-1]] = n

    def cost(context, byte):
        if context is None:
            return 8.0
        found = contexts[context]
        total, kinds = sum(found.values()), len(found)
        lower = context[1:] if context else None
        if byte in found:
            return math.log2((total + kinds) / found[byte])
        return math.log2((total + kinds) / kinds) + cost(lower, byte)

    def node(before):
        for n in range(1, langid.ORDER + 1):
            c = before[-n:]
            if sum(contexts.get(c, {}).values()) < langid.MIN_CONTEXT:
                return before[len(before) - n + 1 :] if n > 1 else b""
        return before[-langid.ORDER :]

    text = b"cabra zada abrac"
    data = b"\n" * langid.ORDER + text
    want = sum(cost(node(data[:i]), data[i]) for i in range(langid.ORDER, len(data)))
    alone, pair = trees.bits([text])[0, 0], trees.bits([b"xx", text])[1, 0]
    assert alone == pytest.approx(want, abs=1e-3) and pair == pytest.approx(alone, abs=1e-6)


# --- registration


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
