"""Language of a text by prediction by partial matching over bytes.

For each language a tree of byte contexts up to ``ORDER`` long is counted on labelled texts
and frozen. In a context with ``n`` counts of ``d`` distinct bytes, a seen byte costs
``-log2(c / (n + d))`` bits; another costs the escape ``-log2(d / (n + d))`` plus its cost in
the context that is one byte shorter; below the empty context all bytes are equally likely.
With frozen counts the cost of a byte in a context is a number, so each tree becomes a table
of costs and one of steps to longer contexts. Scoring walks every position of a text back
along its context and sums the code length under each language.

The tables are pruned: grams of three or more bytes seen under 3 times are dropped before
``n`` and ``d`` are taken, and a tree keeps ``MAX_CONTEXTS`` contexts. Code lengths are exact
for the pruned tables only; escapes in contexts with dropped grams differ from those of the
full counts. Every text is scored whole.

The language with the least code length wins. ``score`` is its share when code lengths of at
most ``SCORE_BYTES`` bytes are turned into probabilities. Null texts and those without a
letter are ``und`` with score 0, as is everything if no labelled text is there. Rows with
equal ids keep one row each; ASCII capitals count as small letters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import text_blocks, width
from shelfrank.llm.toxicity import held_out

ORDER = 4
# Labelled documents per language to learn from, those with the smallest hashes of their ids.
SAMPLE_PER_LANG = 1500
# Contexts of a language's tree: seen at least so often, the most frequent if there are more.
MIN_CONTEXT, MAX_CONTEXTS = 24, 12_000
SCORE_BYTES = 40
UNKNOWN = "und"


@dataclass
class Trees:
    """Per language ``cost[node, symbol]`` and ``step[node, symbol]``, over common symbols.

    ``symbol[byte]`` numbers the bytes seen; 0 stands for all others. Node ``i`` below
    ``nodes`` can be extended, ``nodes + i`` is the same context after a failed step.
    """

    langs: list[str]
    symbol: np.ndarray
    trees: list[tuple[np.ndarray, np.ndarray]]

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language."""
        # Each text starts after a gap as long as a context, so no text depends on another.
        data = np.frombuffer((b"\n" * ORDER).join([b"", *texts]), np.uint8)
        x = self.symbol[data]
        ends = np.cumsum([len(t) + ORDER for t in texts])
        starts = ends - [len(t) for t in texts]
        inside = starts < ends  # reduceat needs texts with bytes
        out = np.zeros((len(texts), len(self.langs)))
        width = len(self.trees[0][0][0])
        for k, (cost, step) in enumerate(self.trees):
            node = np.zeros(len(x), np.int32)
            flat = step.ravel()
            for back in range(1, ORDER + 1):
                node[back:] = flat.take(node[back:] * width + x[:-back])
            nodes = len(step) // 2
            node[node >= nodes] -= nodes
            sums = np.concatenate([[0.0], np.cumsum(cost.ravel().take(node * width + x), dtype=np.float64)])
            out[:, k] = sums[ends] - sums[starts]
        out[~inside] = 0
        return out


def tree(grams: list[dict[bytes, int]], symbol: np.ndarray, n_symbols: int):
    """Tables of one language from counts of 1 to ORDER + 1 bytes."""
    contexts: dict[bytes, dict[int, int]] = {b"": {}}
    for counts in grams:
        for gram, n in counts.items():
            contexts.setdefault(gram[:-1], {})[gram[-1]] = n
    weight = {c: sum(f.values()) for c, f in contexts.items()}
    kept = {b""}
    for c in sorted(contexts, key=lambda c: (-weight[c], len(c), c)):
        # A context is reached through its suffixes, which are at least as frequent.
        if c and weight[c] >= MIN_CONTEXT and c[1:] in kept and len(kept) < MAX_CONTEXTS:
            kept.add(c)
    order = sorted(kept, key=lambda c: (len(c), c))
    number = {c: i for i, c in enumerate(order)}
    n = len(order)
    cost = np.zeros((n, n_symbols), np.float32)
    step = np.tile((np.arange(2 * n) % n + n)[:, None], (1, n_symbols)).astype(np.int32)
    for c in order:
        i, found = number[c], contexts[c]
        lower = cost[number[c[1:]]] if c else np.full(n_symbols, 8.0, np.float32)
        total, kinds = sum(found.values()), len(found)
        if kinds:
            cost[i] = lower + np.log2((total + kinds) / kinds)
            for b, count in found.items():
                cost[i, symbol[b]] = np.log2((total + kinds) / count)
        else:
            cost[i] = lower
        if c:
            step[number[c[1:]], symbol[c[0]]] = i
    return cost, step


def fit(docs: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> Trees:
    """Trees of all languages from labelled rows that aren't held out.

    Grams are counted in Spark, with partial sums per block of text.
    """
    labelled = docs.where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out()
    ).select("doc_id", "lang")
    langs = sorted(r.lang for r in labelled.select("lang").distinct().collect())
    picked = None
    for lang in langs:  # a bounded number of rows each, found with partial top-k
        part = labelled.where(F.col("lang") == lang).orderBy(F.xxhash64("doc_id"), "doc_id")
        part = part.limit(sample_per_lang).distinct()
        picked = part if picked is None else picked.union(part)
    if picked is None:
        return Trees([], np.zeros(256, np.int64), [])
    sample = docs.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"])

    def count(batches):
        for rows, texts in text_blocks(batches, ["lang"], "text"):
            by_lang: dict[str, list[bytes]] = {}
            for (lang,), text in zip(rows, texts, strict=True):
                by_lang.setdefault(lang, []).append(text.lower())
            for lang, own in by_lang.items():
                data = np.frombuffer((b"\n" * ORDER).join([b"", *own]), np.uint8).astype(np.uint64)
                code = np.zeros(len(data), np.uint64)
                for n in range(1, ORDER + 2):
                    code = code[: len(data) - n + 1] << np.uint64(8) | data[n - 1 :]
                    gram, times = np.unique(code, return_counts=True)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "lang": [lang] * len(gram),
                            "size": pa.array(np.full(len(gram), n, np.int32)),
                            "gram": gram.astype(np.int64),
                            "n": times,
                        }
                    )

    counts = (
        sample.repartition(width(docs.sparkSession), "doc_id")
        .mapInArrow(count, "lang string, size int, gram bigint, n bigint")
        .groupBy("lang", "size", "gram")
        .agg(F.sum("n").alias("n"))
        # Pruning: n and d of the contexts that stay do not count the rarer grams.
        .where((F.col("n") >= 3) | (F.col("size") <= 2))
        .toPandas()
    )
    seen = np.unique(counts.gram[counts["size"] == 1].to_numpy())
    symbol = np.zeros(256, np.int64)
    symbol[seen] = np.arange(1, len(seen) + 1)
    symbol[np.arange(65, 91)] = symbol[np.arange(97, 123)]
    trees = []
    for lang in langs:
        own = counts[counts.lang == lang]
        grams = []
        for n in range(1, ORDER + 2):
            part = own[own["size"] == n]
            keys = [int(g).to_bytes(n, "big") for g in part.gram]
            grams.append(dict(zip(keys, part.n.tolist(), strict=True)))
        trees.append(tree(grams, symbol, len(seen) + 1))
    return Trees(langs, symbol, trees)


def identify(docs: DataFrame, trees: Trees, id_col: str = "doc_id") -> DataFrame:
    """``id_col, lang_pred, score`` of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        model = shared.value
        for rows, texts in text_blocks(batches, [id_col, "has_letter"], "text"):
            letters = np.array([r[1] for r in rows], bool)
            names = np.full(len(rows), UNKNOWN, object)
            score = np.zeros(len(rows))
            if model.langs:
                bits = model.bits(texts)
                names = np.array(model.langs, object)[bits.argmin(1)]
                sizes = np.array([max(1, len(t)) for t in texts])
                gap = (bits - bits.min(1, keepdims=True)) * (np.minimum(sizes, SCORE_BYTES) / sizes)[:, None]
                score = 1 / np.exp2(-gap).sum(1)
            names[~letters], score[~letters] = UNKNOWN, 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())),
                    pa.array(names, pa.string()),
                    pa.array(score),
                ],
                [id_col, "lang_pred", "score"],
            )

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(id_col, "text", letter.alias("has_letter")).mapInArrow(
        run, f"`{id_col}` {kind}, lang_pred string, score double"
    )
