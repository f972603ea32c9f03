"""Periodic runs of words: found by splitting at rare words, then scanning lags.

A run is a stretch of consecutive words with smallest period ``q`` and a length of at least
``max(MIN_LENGTH, MIN_COPIES * q)`` that no neighbouring word extends. Each of its words
stands in it at least ``MIN_COPIES`` times (a period that the least length holds more often
than that makes it more, never less). So:

1. *Splitting.* A word that occurs fewer than ``MIN_COPIES`` times in its segment is in no run
   of that segment and splits it. The parts are counted again, those shorter than
   ``MIN_LENGTH`` go, until no word is too rare. All segments of a block of texts are counted
   at once. Most texts vanish in the first rounds.
2. *Lag scan.* A lag is scanned where it can be a smallest period: in a run of period ``q``
   and for any ``k`` from ``q`` up to ``2q - 1``, the ``k`` words at a place next occur exactly
   ``q`` words later, and only there would a smaller lag contradict the smallest period. So
   for k = 8, 16, 32, ... each place gets the lag to the next equal ``k`` words, and stretches
   of places with one lag in (k/2, k] are runs, whole and at full length. Words are compared
   by 64-bit hashes, then by themselves.

Cost per text of n surviving words: a sort for each doubling of k, so n log n times log n,
where scanning every lag takes n * n. Each row is worked on alone; nothing is shuffled, and
lost tasks are simply run again. Memory holds a block of texts, or one longer text.

Defined cases: null texts have no words. Repeated rows and null ids give a row each. Extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfrank.llm.common import byte_set, hashed_words, mix, text_blocks

MIN_LENGTH = 24
MIN_COPIES = 3
BLOCK_BYTES = 1 << 20
IS_WORD = byte_set(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
PLACES = ("start", "length", "period")
RUN = "struct<start:bigint,length:bigint,period:bigint>"
RUNS = f"doc_id bigint, n_words bigint, runs array<{RUN}>, strongest {RUN}, text string"


def surviving(words: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Places of the words left after splitting, ascending; ``segment`` never decreases.

    Segments of the result are the stretches of consecutive places within a segment.
    """
    place = np.arange(len(words))
    while len(place):
        new = np.ones(len(place), bool)
        new[1:] = (np.diff(place) != 1) | (segment[place[1:]] != segment[place[:-1]])
        part = np.cumsum(new) - 1
        long = np.bincount(part) >= MIN_LENGTH
        keep = long[part]
        if not keep.all():
            place, part = place[keep], part[keep]
        _, inverse, count = np.unique(
            mix(words[place] ^ mix(part.astype(np.uint64))), return_inverse=True, return_counts=True
        )
        common = count[inverse] >= MIN_COPIES
        if common.all():
            return place
        place = place[common]
    return place


def scan(words: np.ndarray, place: np.ndarray, segment: np.ndarray) -> list[tuple[int, int, int]]:
    """``start, length, period`` of every run among the surviving places."""
    found = []
    if not len(place):
        return found
    new = np.ones(len(place), bool)
    new[1:] = (np.diff(place) != 1) | (segment[place[1:]] != segment[place[:-1]])
    part = np.cumsum(new) - 1
    ends = np.append(np.flatnonzero(new)[1:], len(place))[part]
    # Hashes of k words, doubled each round; places whose k words leave the segment drop out.
    code = mix(words[place] ^ mix(part.astype(np.uint64)))
    k = 1
    while k < 8:
        code, k = doubled(code, k), 2 * k
    while True:
        # A run of a period above k/2 has three copies inside its segment.
        at = np.arange(len(place))
        room = np.bincount(part)[part] >= max(
            MIN_LENGTH, MIN_COPIES * (k // 2 + 1) if k > 8 else 0
        )
        at = at[room & (at + k <= ends)]
        if not len(at):
            return found
        order = at[np.argsort(code[at], kind="stable")]
        same = code[order[1:]] == code[order[:-1]]
        lag = np.zeros(len(place), np.int64)
        lag[order[:-1][same]] = (order[1:] - order[:-1])[same]
        lag[(lag > k) | ((lag <= k // 2) & (k > 8))] = 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], lag, [0]])))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            q = int(lag[a])
            length = b - 1 - a + k + q
            if q and length >= max(MIN_LENGTH, MIN_COPIES * q):
                found.append((int(place[a]), length, q))
        code, k = doubled(code, k), 2 * k


def doubled(code: np.ndarray, k: int) -> np.ndarray:
    """Hashes of 2k words from those of k words; without a second half the hash is of no use."""
    out = code.copy()
    with np.errstate(over="ignore"):
        out[:-k] = mix(code[:-k] * np.uint64(0x9E3779B97F4A7C15) + mix(code[k:] + np.uint64(k)))
    return out


def find_runs(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """Runs of each list of words (bytes), by start and period."""
    hashes, first = hashed_words([b" ".join(t) for t in texts], IS_WORD, lower=False)
    sizes = np.diff(first)
    segment = np.repeat(np.arange(len(texts)), sizes)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, q in scan(hashes, surviving(hashes, segment), segment):
        doc = int(segment[start])
        start -= int(first[doc])
        words = texts[doc]
        if words[start : start + length - q] != words[start + q : start + length]:
            raise ArithmeticError("two words share a hash")
        found[doc].append((start, length, q))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without all copies of a run after its first."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        drop[start + q] += 1
        drop[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
    return [words[i] for i in kept.tolist()]


def planted(doc_id: int | None, words: list) -> list:
    """The words with the contract's repetition written in, for one id in ten."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def word_blocks(batches: Iterator, rewrite=None) -> Iterator[tuple[list, list[list]]]:
    """Rows and words of a block; ``rewrite(doc_id, words)`` may change the words."""
    for rows, texts in text_blocks(batches, ["doc_id"], "text", BLOCK_BYTES):
        ids = [r[0] for r in rows]
        words = [t.split() for t in texts]
        if rewrite:
            words = [rewrite(i, w) for i, w in zip(ids, words, strict=True)]
        yield ids, words


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most copies (exactly), then the first, then that of the least period."""
    return min(runs, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2]), default=None)


def periodic_runs(docs: DataFrame, rewrite=None) -> DataFrame:
    """``doc_id, n_words, runs, strongest, text``.

    ``runs`` come by start and period. ``text`` has the kept words joined by one blank: a word
    goes if a run holds it after that run's first period.
    """
    struct = pa.struct([(c, pa.int64()) for c in PLACES])

    def named(r):
        return r and dict(zip(PLACES, r, strict=True))

    def run(batches):
        for ids, words in word_blocks(batches, rewrite):
            runs = find_runs(words)
            kept = [b" ".join(collapsed(w, r)).decode() for w, r in zip(words, runs, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([[named(r) for r in x] for x in runs], pa.list_(struct)),
                    pa.array([named(strongest(x)) for x in runs], struct),
                    pa.array(kept, pa.string()),
                ],
                ["doc_id", "n_words", "runs", "strongest", "text"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, RUNS)
