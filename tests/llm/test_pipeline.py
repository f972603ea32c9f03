"""The five stages in a row on small tables: what goes, what stays, and that ids are whole."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"
BOILER = "subscribe to our newsletter today"


def written(spark, folder, docs, labels, bench):
    spark.createDataFrame([(*d, "en", "hot", 9) for d in docs], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def packed(rows):
    """Ids of each document; checks that pieces and sequences have no gaps."""
    docs, places = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append((r.piece, r.start, r.length, bytes(r.ids)))
        places[r.sequence_id].append((r.offset, r.length))
    for pieces in docs.values():
        pieces.sort()
        at = 0
        for n, (piece, start, length, ids) in enumerate(pieces):
            assert (piece, start, 4 * length) == (n, at, len(ids))
            at += length
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    return {d: np.frombuffer(b"".join(p[3] for p in pieces), "<u4").tolist() for d, pieces in docs.items()}


def test_pipeline_keeps_and_drops_what_its_stages_say(spark, tmp_path):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randint(3, 8))) for _ in range(900)]
    foul = ["".join(rng.choices("uvwxyz", k=6)) for _ in range(5)]

    def body(n, toxic=False):
        picked = rng.choices(words, k=n)
        return " ".join(picked + (rng.choices(foul, k=n) if toxic else []))

    passage = body(40)
    clean = {i: body(90) for i in range(1, 121)}
    toxic = {i: body(20, True) for i in range(200, 280)}
    boiled = {i: body(60) + f"\n{BOILER} \n" + body(5) for i in range(400, 440)}
    docs = [*clean.items(), *toxic.items(), *boiled.items()]
    docs += [(i, clean[5]) for i in range(300, 360)] + [(1, clean[1])]  # copies, a repeated row
    docs += [(500, passage + " " + body(20)), (501, None), (502, ""), (503, body(3000))]
    labels = [(i, 1, 0) for i in clean] + [(i, 0, 1) for i in toxic]
    folder = written(spark, tmp_path / "in", docs, labels, [(1, passage), (2, None)])

    table = spark.read.parquet(f"{folder}/documents.parquet")
    first = P.drop_toxic(spark, table, folder)
    assert first.columns == table.columns
    left = [r.doc_id for r in first.collect()]
    assert not set(left) & set(toxic)
    assert len(left) == len(docs) - len(toxic)

    # Every row in is accounted for: copies, the repeated row, the contaminated document, and
    # one of the two without words (their fingerprints are equal).
    got = packed(P.run(spark, folder).collect())
    want = {**clean, **boiled, 501: "", 503: next(t for i, t in docs if i == 503)}
    want.update({i: t.replace(f"\n{BOILER} \n", "\n") for i, t in boiled.items()})
    assert set(got) == set(want)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for doc, text in want.items():
        assert got[doc] == [*tokenizer.encode(text, add_special_tokens=False).ids, 0], doc


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)]])
def test_pipeline_of_no_documents(spark, tmp_path, labels):
    folder = written(spark, tmp_path / "in", [], labels, [])
    assert P.run(spark, folder).count() == 0
