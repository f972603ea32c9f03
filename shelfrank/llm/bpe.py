"""Byte-level BPE by DuckDB queries inside each task, and back from ids to bytes.

*Encoding.* A text is cut by the vocabulary's pattern; equal words are encoded once per worker.
New words become rows (word, position, token), one per byte. A recursive query joins
neighbouring rows with the merge table (two tokens and the token their bytes make, by rank)
and contracts each word's leftmost pair of least rank, until no word has a pair left. A word
that is a token itself is that token.

Words of over ``SHORT`` bytes take a second form of the query, which contracts further pairs of
that rank in the same step, left to right, as long as no earlier contraction of the step makes
a pair of lower rank: then the next steps would take just these. So a word of many equal
pairs takes few steps. The recursion keeps all its steps, so this query takes a bounded number
of bytes and steps, and words that aren't finished go on in the next one from where they are.

*Decoding.* The tokens' bytes are looked up and put together in order.

DuckDB lives in the task's process, with one thread, a memory limit and no folder to spill to.
Rows are worked on alone: nothing is shuffled, and lost tasks are run again.

Defined cases: null texts are empty, with no ids. Repeated rows and null ids give a row each.
Bytes in DuckDB are characters 0 to 255.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfrank.llm.common import text_blocks

BLOCK_BYTES = 1 << 20
# Of a query: bytes of words (a longer word is alone), rows of all its steps. Ids decoded at once.
WORD_BYTES, STEP_ROWS, DECODE_IDS = 1 << 17, 1 << 20, 250_000
SHORT, STEPS = 64, 24
# Words of each of a worker's two caches, about 200 bytes each.
CACHE_WORDS = 300_000
MEMORY = "400MB"
ENCODED = "doc_id bigint, n_tokens bigint, ids binary"
_coders: dict = {}

TABLES = """
CREATE TABLE token AS SELECT id, body FROM given ORDER BY id;
CREATE TABLE merge AS
  SELECT l.id AS a, r.id AS b, w.id AS c
  FROM (SELECT id, body, unnest(range(1, length(body))) AS cut FROM token) w
  JOIN token l ON l.body = substr(w.body, 1, w.cut)
  JOIN token r ON r.body = substr(w.body, w.cut + 1);
CREATE TABLE pair AS SELECT (a::BIGINT << 20) | b AS ab, c::BIGINT AS c FROM merge;
-- Pairs that come up by a contraction and have a lower rank than it had.
CREATE TABLE upset AS SELECT a, b, c FROM merge WHERE c < a OR c < b;
CREATE TABLE state (word INTEGER, pos INTEGER, id INTEGER);
"""

START = """
INSERT INTO state
SELECT word, i, id FROM (
  SELECT word, i, substr(body, i, 1) AS byte FROM (
    SELECT word, body, unnest(range(1, length(body) + 1)) AS i FROM fresh))
JOIN token ON body = byte
"""

# ``k`` is word * 256 + place; ``rank`` has the place in its lower bits too, so a word's least
# rank also tells the first place that has it.
SHORT_WORDS = """
WITH RECURSIVE walk(step, k, id) AS (
  SELECT 0, (word::BIGINT << 8) | pos, id FROM state
  UNION ALL (
    WITH joined AS (
      SELECT l.step, l.k, l.id, (c << 8) | (l.k & 255) AS rank
      FROM walk l LEFT JOIN walk r ON r.k = l.k + 1
      LEFT JOIN pair ON ab = (l.id::BIGINT << 20) | r.id),
    least AS (
      SELECT k >> 8 AS word, min(rank) AS best FROM joined WHERE rank IS NOT NULL GROUP BY ALL)
    SELECT step + 1, k - ((k & 255) > (best & 255))::INTEGER,
           CASE WHEN rank = best THEN (best >> 8)::INTEGER ELSE id END
    FROM joined JOIN least ON word = k >> 8 WHERE (k & 255) <> (best & 255) + 1
  )
)
SELECT word::INTEGER AS word, list(id ORDER BY k) AS ids
FROM walk JOIN (SELECT k >> 8 AS word, max(step) AS last FROM walk GROUP BY ALL)
  ON word = k >> 8 AND step = last
GROUP BY word
"""

CONTRACT = """
CREATE OR REPLACE TEMP TABLE walked AS
WITH RECURSIVE walk(step, word, pos, id) AS (
  SELECT 0, word, pos, id FROM state
  UNION ALL (
    WITH near AS (
      SELECT step, word, pos, id, row_number() OVER w AS i,
             lag(id) OVER w AS before, lead(id) OVER w AS after, lead(id, 2) OVER w AS beyond
      FROM walk WHERE step < $steps WINDOW w AS (PARTITION BY word ORDER BY pos)),
    joined AS (
      SELECT near.*, c, min(c) OVER (PARTITION BY word) AS least
      FROM near LEFT JOIN merge ON id = a AND after = b),
    -- In a chain of pairs that share tokens every second one is taken.
    least_pairs AS (
      SELECT *, i - row_number() OVER (PARTITION BY word ORDER BY i) AS chain
      FROM joined WHERE c = least),
    taken AS (
      SELECT * FROM least_pairs
      QUALIFY (i - min(i) OVER (PARTITION BY word, chain)) % 2 = 0),
    -- What a contraction leaves beside it: the pairs with its neighbours, or with its like.
    beside AS (
      SELECT word, i, least, before AS a, least AS b FROM taken
      UNION ALL SELECT word, i, least, least, beyond FROM taken
      UNION ALL SELECT word, i, least, least, least FROM taken),
    judged AS (
      SELECT word, i, bool_or(coalesce(upset.c < least, false)) AS upsets
      FROM beside LEFT JOIN upset USING (a, b) GROUP BY word, i),
    done AS (
      SELECT word, i FROM judged
      QUALIFY coalesce(sum(upsets::INTEGER) OVER (
        PARTITION BY word ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0)
    SELECT step + 1, joined.word, pos, CASE WHEN left_one.i IS NULL THEN id ELSE least END
    FROM joined
    LEFT JOIN done left_one ON left_one.word = joined.word AND left_one.i = joined.i
    LEFT JOIN done right_one ON right_one.word = joined.word AND right_one.i = joined.i - 1
    WHERE least IS NOT NULL AND right_one.i IS NULL
  )
)
SELECT word, pos, id, step FROM walk QUALIFY step = max(step) OVER (PARTITION BY word);
"""

FINISHED = """
SELECT word, list(id ORDER BY pos) AS ids FROM walked WHERE step < $steps GROUP BY word
"""

GO_ON = """
DELETE FROM state;
INSERT INTO state SELECT word, pos, id FROM walked WHERE step = $steps;
"""

def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class Coder:
    """A worker's connection with the tables of one vocabulary, and the words seen lately."""

    def __init__(self, path: str, pattern: str):
        self.load(read_ranks(path), pattern)

    def load(self, ranks: dict[bytes, int], pattern: str) -> None:
        import duckdb
        import regex

        self.find = regex.compile(pattern).findall
        self.whole = {body: np.array([i], "<u4").tobytes() for body, i in ranks.items()}
        self.bodies = {i: body for body, i in ranks.items()}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.db = duckdb.connect(
            config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""}
        )
        self.put("given", id=pa.array(ranks.values(), pa.int32()), body=letters(ranks))
        self.db.execute(TABLES)
        self.db.unregister("given")

    def put(self, name: str, **columns) -> None:
        self.db.register(name, pa.table(columns))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        words = [self.find(t) for t in texts]
        new = set().union(*words).difference(self.cache)
        known = new.intersection(self.older)
        self.cache.update((w, self.older[w]) for w in known)
        coded = [(w, w.encode()) for w in new.difference(known)]
        self.cache.update((w, self.whole[body]) for w, body in coded if body in self.whole)
        rest = [(w, body) for w, body in coded if body not in self.whole]
        short = [x for x in rest if len(x[1]) <= SHORT]
        long = [x for x in rest if len(x[1]) > SHORT]
        for part in in_parts(short):
            self.learn(part, self.short_ids)
        for part in in_parts(long):
            self.learn(part, self.long_ids)
        get = self.cache.__getitem__
        out = [b"".join(map(get, w)) for w in words]
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.older = {}, self.cache
        return out

    def learn(self, part: list[tuple[str, bytes]], ids_of) -> None:
        """Puts the ids of words that aren't tokens into the cache."""
        bodies = [body for _, body in part]
        self.put("fresh", word=pa.array(range(len(part)), pa.int32()), body=letters(bodies))
        self.db.execute(START)
        for found in ids_of(sum(map(len, bodies))):
            lists = found["ids"].combine_chunks()
            data = lists.values.to_numpy().astype("<u4").tobytes()
            ends = (4 * lists.offsets.to_numpy()).tolist()
            for word, a, b in zip(found["word"].to_pylist(), ends[:-1], ends[1:], strict=True):
                self.cache[part[word][0]] = data[a:b]
        self.db.execute("DELETE FROM state")

    def short_ids(self, size: int):
        yield self.db.sql(SHORT_WORDS).to_arrow_table()

    def long_ids(self, size: int):
        steps = str(max(1, min(STEPS, STEP_ROWS // size)))
        while self.db.execute("SELECT count(*) FROM state").fetchone()[0]:
            self.db.execute(CONTRACT.replace("$steps", steps))
            yield self.db.sql(FINISHED.replace("$steps", steps)).to_arrow_table()
            self.db.execute(GO_ON.replace("$steps", steps))

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids; ids that no token has are left out."""
        return [b"".join(map(self.bytes_of, parts_of(x, 4 * DECODE_IDS))) for x in ids]

    def bytes_of(self, ids: bytes) -> bytes:
        return b"".join(filter(None, map(self.bodies.get, np.frombuffer(ids, "<u4").tolist())))


def parts_of(data: bytes, size: int) -> Iterable[bytes]:
    return (data[a : a + size] for a in range(0, len(data), size))


def letters(bodies: Iterable[bytes]) -> pa.Array:
    return pa.array([b.decode("latin-1") for b in bodies], pa.string())


def in_parts(words: list[tuple[str, bytes]]) -> Iterable[list[tuple[str, bytes]]]:
    part, size = [], 0
    for word in words:
        if part and size + len(word[1]) > WORD_BYTES:
            yield part
            part, size = [], 0
        part.append(word)
        size += len(word[1])
    if part:
        yield part


def coder(path: str, pattern: str) -> Coder:
    """The worker's coder for a rank file, kept between its tasks."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit) of every row."""

    def run(batches):
        own = coder(ranks, pattern)
        for rows, texts in text_blocks(batches, ["doc_id"], "text", BLOCK_BYTES):
            ids = own.encode([t.decode() for t in texts])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                ["doc_id", "n_tokens", "ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)


def decode(coded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``coded`` rows of ``encode`` with ``decoded``, the bytes of their ids."""

    def run(batches):
        own = coder(ranks, pattern)
        for rows, ids in text_blocks(batches, ["doc_id", "n_tokens"], "ids", BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(own.decode(ids), pa.binary()),
                ],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    return coded.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"{ENCODED}, decoded binary")
