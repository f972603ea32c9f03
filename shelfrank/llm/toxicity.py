"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the 32-bit hashes of its words, neighbouring pairs, triples and pairs
with one word between, each once. The model is fitted on a bounded sample of labelled rows,
in one task that reads them as a stream; per-coordinate rates come from squared gradients.
A feature needs more than ``L1`` gradients of at most one to leave zero, so rarer ones are
left out beforehand without changing the result. The few weights left are broadcast.

Null and empty texts get the score of the bias alone. Of repeated labels of one document the
highest counts. Without labelled rows every score is 0. Rows with equal ids keep one row each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import byte_set, hashed_words, mix, text_blocks

WORD = byte_set(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
SAMPLE_ROWS = 12_000
ALPHA, BETA, L1, L2 = 0.3, 1.0, 3.0, 1.0
EPOCHS = 4
THRESHOLD = 0.3
# Offsets between the words of a feature.
SHAPES = ((0,), (0, 1), (0, 1, 2), (0, 2))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 when divided by 4."""
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.coalesce(crc % 4 == 2, F.lit(False))


def features(texts: list[bytes], keep=None):
    """``text, feature`` pairs of a block of texts; ``keep`` may pick features early."""
    words, first = hashed_words(texts, WORD)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    found = []
    for kind, shape in enumerate(SHAPES):
        n = len(words) - shape[-1]
        if n <= 0:
            continue
        h = np.full(n, kind + 1, np.uint64)
        for step in shape:
            h = mix(h ^ words[step : step + n])
        code = (h >> np.uint64(32)).astype(np.uint32)
        own = owner[:n]
        ok = own == owner[shape[-1] :]
        if keep is not None:
            ok &= keep(code)
        found.append((own[ok].astype(np.uint64) << np.uint64(32)) | code[ok])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    return (pairs >> np.uint64(32)).astype(np.int64), pairs.astype(np.uint32)


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.bits = np.zeros(1 << 16, bool)
        self.bits[self.features & 0xFFFF] = True

    def scores(self, texts: list[bytes]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        if len(self.features):
            text, code = features(texts, lambda c: self.bits[c & np.uint32(0xFFFF)])
            at = np.minimum(np.searchsorted(self.features, code), len(self.features) - 1)
            hit = self.features[at] == code
            total += np.bincount(text[hit], self.weights[at[hit]], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


class Ftrl:
    """State and step of FTRL-proximal for the log loss over binary features."""

    def __init__(self, size: int):
        self.z = np.zeros(size)
        self.n = np.zeros(size)

    def weights(self, at=slice(None)):
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -40, 40))) - label
        n = self.n[at]
        rate = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[at] += g - rate * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most ``sample_rows`` labelled documents that aren't held out.

    The sample is the labelled ids with the smallest hashes, so it doesn't depend on order.
    """
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("label"))
        .withColumn("turn", F.xxhash64("doc_id"))
        .orderBy("turn", "doc_id")
        .limit(sample_rows)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def extract(batches):
        for rows, texts in text_blocks(batches, ["turn", "label"], "text"):
            text, code = features(texts)
            ends = np.searchsorted(text, np.arange(len(texts) + 1))
            lists = [code[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
            turns, marks = zip(*rows, strict=True)
            yield pa.RecordBatch.from_pydict(
                {"turn": pa.array(turns, pa.int64()), "label": pa.array(marks, pa.int32()), "features": lists}
            )

    def train(batches):
        labels, lists = [], []
        for batch in batches:
            labels += batch.column(1).to_pylist()
            lists += [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(2)]
        known, count = np.unique(np.concatenate([*lists, np.zeros(0, np.uint32)]), return_counts=True)
        known = known[count > L1 / EPOCHS]
        state = Ftrl(len(known) + 1)
        spots = []
        for x in lists:
            at = np.minimum(np.searchsorted(known, x), max(len(known) - 1, 0))
            at = at[known[at] == x] if len(known) else at[:0]
            spots.append(np.append(at, len(known)))  # the last is the bias
        for _ in range(EPOCHS):
            for at, label in zip(spots, labels, strict=True):
                state.learn(at, label)
        w = state.weights()
        some = np.flatnonzero(w[:-1])
        yield pa.RecordBatch.from_pydict(
            {
                "feature": pa.array(np.append(known[some].astype(np.int64), -1)),
                "weight": pa.array(np.append(w[some], w[-1] if labels else -40.0)),
            }
        )

    rows = (
        sample.select("turn", "label", "text")
        .mapInArrow(extract, "turn bigint, label int, features binary")
        .repartition(1)
        .sortWithinPartitions("turn")
        .mapInArrow(train, "feature bigint, weight double")
        .toPandas()
    )
    bias = float(rows.weight[rows.feature == -1].iloc[0]) if len(rows) else -40.0
    rows = rows[rows.feature >= 0].sort_values("feature")
    return Model(rows.feature.to_numpy().astype(np.uint32), rows.weight.to_numpy(), bias)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``score`` of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", score double"

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            done = 0
            for _, texts in text_blocks([batch], [], "text"):
                out[done : done + len(texts)] = shared.value.scores(texts)
                done += len(texts)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(out)], [*keep, "score"]
            )

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            scores = [shared.value.scores(texts) for _, texts in text_blocks([batch], [], "text")]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) < threshold))

    return docs.mapInArrow(run, docs.schema)
