"""Benchmark decontamination with a positional inverted index over the training corpus.

The index is sharded by document: every segment (about 4 MB of text) is one row that holds,
for each of its terms, the sorted list of positions. Words are lower-cased ASCII runs; terms
are 64-bit hashes of words. Documents of a segment are one position apart, so no phrase runs
across two of them. Segments are built where the text is read; nothing is shuffled.

A search sends the benchmark's windows to the segments in slices of bounded size. For each
window a segment starts from the term that is rarest in it and intersects its offset-adjusted
list with the next rarer ones. Proximity matches take spans that hold all terms of an item.

Null texts have no words; such documents and empty ones get zero counts. Items without
words match nothing. Rows with equal ids keep one row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import byte_set, hashed_words, row_key, saved, text_blocks

WINDOW = 13
# Of a search pass; about 60 bytes each are broadcast.
SLICE_WINDOWS = 200_000
# Keys of contaminated rows (25 bytes) up to which they are broadcast.
BROADCAST_KEYS = 200_000
WORD = byte_set(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)

INDEX = "docs array<{id}>, bounds binary, terms binary, counts binary, positions binary"
FOUND = "doc {id}, n_words bigint, n_hit bigint, items array<string>, starts array<int>, lengths array<int>"


def build_index(docs: DataFrame, id_col: str = "doc_id", label: str = "postings") -> DataFrame:
    """The index table: one row per segment, written to the shared folder.

    ``positions`` are gaps within each term's list, ``bounds`` the first position of each
    document and the end of the last.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for rows, texts in text_blocks(batches, [id_col], "text"):
            words, first = hashed_words(texts, WORD)
            sizes = np.diff(first)
            bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
            place = np.arange(len(words)) + np.repeat(np.arange(len(texts)), sizes)
            order = np.argsort(words, kind="stable")
            ordered, place = words[order], place[order]
            starts = np.flatnonzero(np.diff(ordered, prepend=~ordered[:1])) if len(words) else []
            gaps = np.diff(place, prepend=0)
            gaps[starts] = place[starts]
            yield pa.RecordBatch.from_pydict(
                {
                    "docs": pa.array([[r[0] for r in rows]], to_arrow(kind)),
                    "bounds": [bounds.astype("<i8").tobytes()],
                    "terms": [ordered[starts].astype("<u8").tobytes()],
                    "counts": [np.diff(np.append(starts, len(words))).astype("<u4").tobytes()],
                    "positions": [gaps.astype("<u4").tobytes()],
                }
            )

    return saved(docs.select(id_col, "text").mapInArrow(run, INDEX.format(id=kind)), label)


def to_arrow(kind: str) -> pa.DataType:
    return pa.list_({"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string()))


class Segment:
    def __init__(self, row: dict):
        self.docs = row["docs"]
        self.bounds = np.frombuffer(row["bounds"], "<i8")
        self.terms = np.frombuffer(row["terms"], "<u8")
        self.counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
        self.ends = np.cumsum(self.counts)
        gaps = np.cumsum(np.frombuffer(row["positions"], "<u4").astype(np.int64))
        # Each list starts anew: take off what was summed up before it.
        before = np.concatenate([[0], gaps[self.ends[:-1] - 1]]) if len(self.ends) else []
        self.positions = gaps - np.repeat(before, self.counts)

    def lookup(self, terms: np.ndarray):
        """Per term its index here, or -1."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def lists(self, at: np.ndarray):
        """Positions of terms ``at`` one after the other, and the length of each list."""
        n = self.counts[at]
        base = np.repeat(self.ends[at] - n - (np.cumsum(n) - n), n)
        return self.positions[base + np.arange(n.sum())], n

    def doc_of(self, positions: np.ndarray):
        return np.searchsorted(self.bounds, positions, side="right") - 1


def windows_of(words: np.ndarray, size: int) -> list[np.ndarray]:
    if not len(words):
        return []
    if len(words) <= size:
        return [words]
    return list(np.lib.stride_tricks.sliding_window_view(words, size))


def query_slices(items: DataFrame, size: int | None, limit: int) -> Iterator[dict]:
    """Windows of all items in packs of at most ``limit`` (or one item's, if it has more).

    ``size`` None keeps each item whole.
    """
    ids, windows = [], []

    def pack():
        longest = max(map(len, windows))
        vocabulary, code = np.unique(np.concatenate(windows), return_inverse=True)
        lengths = np.array([len(w) for w in windows])
        terms = np.full((len(windows), longest), -1, np.int32)
        terms[np.arange(longest) < lengths[:, None]] = code
        names, item = np.unique(np.array(ids, object), return_inverse=True)
        return {"vocabulary": vocabulary, "terms": terms, "lengths": lengths, "names": names, "item": item}

    for row in items.toLocalIterator():
        words, _ = hashed_words([(row.text or "").encode()], WORD)
        found = windows_of(words, size or max(1, len(words)))
        if windows and len(windows) + len(found) > limit:
            yield pack()
            ids, windows = [], []
        windows += found
        ids += [row.item] * len(found)
    if windows:
        yield pack()


def phrase_starts(seg: Segment, q: dict):
    """``window, start`` of all exact occurrences of the slice's windows in a segment."""
    at = seg.lookup(q["vocabulary"])
    far = np.iinfo(np.int64).max
    count = np.where(at >= 0, seg.counts[np.maximum(at, 0)] if len(seg.counts) else 0, 0)
    count = np.append(count, far)  # of the padding, -1
    frequency = count[q["terms"]]
    alive = np.flatnonzero((frequency > 0).all(1))
    none = np.zeros(0, np.int64)
    if not len(alive):
        return none, none
    order = np.argsort(frequency[alive], axis=1, kind="stable")
    terms = q["terms"][alive]
    used = np.unique(terms[terms >= 0])
    positions, n = seg.lists(at[used])
    keys = (np.repeat(used.astype(np.int64), n) << 40) | positions
    rarest = order[:, 0]
    term = terms[np.arange(len(alive)), rarest]
    positions, n = seg.lists(at[term])
    window = np.repeat(np.arange(len(alive)), n)
    start = positions - rarest[window]
    for r in range(1, terms.shape[1]):
        offset = order[window, r]
        term = terms[window, offset].astype(np.int64)
        want = (term << 40) | np.maximum(start + offset, 0)
        found = keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want
        keep = (term < 0) | (found & (start >= 0))
        window, start = window[keep], start[keep]
    keep = start >= 0
    return alive[window[keep]], start[keep]


def near_spans(seg: Segment, q: dict, slack: int):
    """``window, start, length`` of least spans that hold all distinct terms of an item.

    A span ends at an occurrence of one of the terms, lies in one document and is at most
    ``slack`` words longer than the number of terms.
    """
    at = seg.lookup(q["vocabulary"])
    out = []
    for w, row in enumerate(q["terms"]):
        terms = np.unique(row[row >= 0])
        where = at[terms]
        if (where < 0).any():
            continue
        lists = [seg.lists(where[i : i + 1])[0] for i in range(len(terms))]
        lists.sort(key=len)
        reach = len(terms) + slack
        ends = np.unique(np.concatenate(lists))
        first = ends.copy()
        for places in lists:
            last = np.searchsorted(places, ends, side="right") - 1
            ok = last >= 0
            ends, first, last = ends[ok], first[ok], last[ok]
            first = np.minimum(first, places[last])
            ok = ends - first < reach
            ends, first = ends[ok], first[ok]
        ok = seg.doc_of(first) == seg.doc_of(ends)
        ends, first = ends[ok], first[ok]
        if len(ends):  # of spans with one start the shortest
            first, i = np.unique(first, return_index=True)
            out.append((np.full(len(first), w), first, ends[i] - first + 1))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def search(
    index: DataFrame,
    benchmark: DataFrame,
    window: int | None = WINDOW,
    slack: int | None = None,
    item_col: str = "item_id",
    slice_windows: int = SLICE_WINDOWS,
) -> DataFrame:
    """Per indexed document: ``doc, n_words, n_hit, items, starts, lengths``.

    Exact matches of ``window`` consecutive item words (None: of whole items); with ``slack``
    proximity matches of whole items instead. ``items`` are sorted as strings; ``starts`` and
    ``lengths`` are the hit words as disjoint runs.
    """
    spark = index.sparkSession
    kind = index.schema["docs"].dataType.elementType.simpleString()
    schema = FOUND.format(id=kind)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), "text").where(
        F.col("text").isNotNull() & F.col(item_col).isNotNull()
    )
    size = None if slack is not None else window
    passes = []
    for pack in query_slices(items, size, slice_windows):
        passes.append(one_pass(index, spark.sparkContext.broadcast(pack), slack, schema, kind))
    if not passes:
        empty = {k: np.zeros(0, np.int64) for k in ("lengths", "item")}
        pack = empty | {"vocabulary": np.zeros(0, np.uint64), "terms": np.zeros((0, 1), np.int32), "names": []}
        passes.append(one_pass(index, spark.sparkContext.broadcast(pack), slack, schema, kind))
    if len(passes) == 1:
        return passes[0].drop("row")
    every = passes[0]
    for other in passes[1:]:
        every = every.union(other)
    return merged(every)


def one_pass(index: DataFrame, query, slack, schema: str, kind: str) -> DataFrame:
    def run(batches):
        q = query.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield table(Segment(row), q)

    def table(seg: Segment, q: dict):
        if slack is None:
            w, start = phrase_starts(seg, q)
            length = q["lengths"][w] if len(w) else w
        else:
            w, start, length = near_spans(seg, q, slack)
        total = int(seg.bounds[-1])
        edge = np.zeros(total + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + length, -1)
        hit = (np.cumsum(edge) > 0).astype(np.int8)
        turn = np.diff(hit, prepend=0)
        runs, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        doc = seg.doc_of(runs)
        n = len(seg.docs)
        per_doc = np.bincount(doc, ends - runs, minlength=n).astype(np.int64)
        rows = {
            "doc": pa.array(seg.docs, to_arrow(kind).value_type),
            "n_words": np.diff(seg.bounds) - 1,
            "n_hit": per_doc,
        }
        of, item = seg.doc_of(start), q["item"][w]
        pairs = np.unique(np.stack([of, item], 1), axis=0) if len(w) else np.zeros((0, 2), int)
        rows["items"] = nested(pairs[:, 0], np.array([str(x) for x in q["names"]], object)[pairs[:, 1]] if len(pairs) else [], n, pa.string())
        rows["starts"] = nested(doc, runs - seg.bounds[doc], n, pa.int32())
        rows["lengths"] = nested(doc, ends - runs, n, pa.int32())
        return pa.RecordBatch.from_pydict(rows)

    def nested(rows, values, n, kind):
        offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))

    found = index.mapInArrow(run, schema)
    return found.withColumn("row", F.monotonically_increasing_id())


def merged(every: DataFrame) -> DataFrame:
    """Passes over one index joined by row; runs of hit words united."""

    def run(pdf):
        import pandas as pd

        first = pdf.iloc[0]
        spans = sorted(
            (s, s + n) for x, y in zip(pdf.starts, pdf.lengths, strict=True) for s, n in zip(x, y, strict=True)
        )
        joined: list[list[int]] = []
        for s, e in spans:
            if joined and s <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], e)
            else:
                joined.append([s, e])
        return pd.DataFrame(
            {
                "doc": [first.doc],
                "n_words": [first.n_words],
                "n_hit": [sum(e - s for s, e in joined)],
                "items": [sorted({x for row in pdf["items"] for x in row})],
                "starts": [[s for s, _ in joined]],
                "lengths": [[e - s for s, e in joined]],
            }
        )

    kind = every.schema["doc"].dataType.simpleString()
    return every.groupBy("row").applyInPandas(run, FOUND.format(id=kind))


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id"
) -> DataFrame:
    """``search`` of a corpus indexed here, with the id under its own name.

    ``contaminated``: at least one twentieth of the words (and one) lie in benchmark windows.
    """
    found = search(build_index(docs, id_col), benchmark, window)
    flag = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return found.withColumnRenamed("doc", id_col).withColumn("contaminated", flag)



def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that aren't ``contaminated``, with all their columns."""
    keyed = docs.select(F.struct("*").alias("row"), row_key(docs).alias("key"), "text")
    flagged = contamination(keyed, benchmark, window, "key").where("contaminated")
    flagged = saved(flagged.select("key"), "contaminated")
    if flagged.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        flagged = F.broadcast(flagged)
    return keyed.join(flagged, "key", "left_anti").select("row.*")
