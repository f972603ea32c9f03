"""Packing of tokenised documents into sequences by best fit and swap-based local search.

Documents longer than a sequence are cut into full pieces and a rest; nothing else is cut.
Full pieces are sequences of their own. All others are dealt by hash into groups of bounded
size, each packed in one task: best fit, largest first, then local search between underfull
sequences. A move of one piece, or an exchange of one for one or of two for one, is made if
it raises the sum of squared fills, so the fullest close and the emptiest run dry. Sequences
a group couldn't fill well are opened and packed again with those of other groups.

Null and empty texts are one end id. Equal rows are separate documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import saved, text_blocks
from shelfrank.llm.tokens import encoder

LENGTH = 2048
END = 0
GROUP_PIECES = 16_000
# Sequences filled less than this are opened for the next round.
WELL_FILLED = 0.97
PASSES = 3
# At most; each packs only what the one before left badly filled.
ROUNDS = 6


def token_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, id_col: str = "doc_id") -> DataFrame:
    """``uid, id_col, piece, start, length, ids`` in the shared folder; ``uid`` marks a piece."""
    kind = docs.schema[id_col].dataType.simpleString()
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 36
        code = encoder(tokenizer)
        for rows, texts in text_blocks(batches, [id_col], "text"):
            columns: list[list] = [[], [], [], [], [], []]
            for (doc,), data in zip(rows, code.encode([t.decode() for t in texts]), strict=True):
                data += last
                for piece, at in enumerate(range(0, len(data), 4 * length)):
                    body = data[at : at + 4 * length]
                    row = (uid, doc, piece, at // 4, len(body) // 4, body)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    uid += 1
            kinds = [pa.int64(), None, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            kinds[1] = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["uid", id_col, "piece", "start", "length", "ids"],
            )

    schema = f"uid bigint, `{id_col}` {kind}, piece int, start bigint, length bigint, ids binary"
    return saved(docs.select(id_col, "text").mapInArrow(run, schema), "pieces")


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Bins of indices: each size, largest first, into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_space: list[list[int]] = [[] for _ in range(room + 1)]
    open_spaces = 0  # bit s is set if some bin has s left
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fitting = open_spaces >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                open_spaces &= ~(1 << space)
            bins[b].append(i)
        else:
            space, b = room, len(bins)
            bins.append([i])
        by_space[space - size].append(b)
        open_spaces |= 1 << (space - size)
    return bins


class Search:
    """Local search over bins; all steps raise the sum of squared fills."""

    def __init__(self, sizes: list[int], bins: list[list[int]], room: int):
        self.sizes, self.bins, self.room = sizes, bins, room
        self.fill = [sum(sizes[i] for i in b) for b in bins]

    def run(self, passes: int = PASSES) -> list[list[int]]:
        least = -(-sum(self.sizes) // self.room)
        for _ in range(passes):
            used = [b for b in range(len(self.bins)) if self.fill[b]]
            excess = len(used) - least
            if excess <= 0:  # no packing has fewer
                break
            order = sorted((b for b in used if self.fill[b] < self.room), key=lambda b: -self.fill[b])
            givers = order[-2 * excess - 2 :][::-1]
            if not sum([self.drain(order, giver) for giver in givers]):
                break
        return [b for b in self.bins if b]

    def drain(self, order: list[int], giver: int) -> int:
        """Steps from one of the emptiest bins into fuller ones, the fullest first."""
        steps = 0
        for taker in order:
            if not self.bins[giver]:
                break
            if taker != giver and self.room > self.fill[taker] >= self.fill[giver]:
                steps += self.improve(taker, giver)
        return steps

    def improve(self, taker: int, giver: int) -> int:
        """The step between two bins that leaves the least room in ``taker``."""
        space = self.room - self.fill[taker]
        best, step = 0, None
        sizes = self.sizes
        mine, theirs = self.bins[taker], self.bins[giver]
        for j in theirs:
            if best < sizes[j] <= space:
                best, step = sizes[j], ([], [j])
        if best < space:
            for i in mine:
                for n, j in enumerate(theirs):
                    gain = sizes[j] - sizes[i]
                    if best < gain <= space:
                        best, step = gain, ([i], [j])
                    for other in theirs[n + 1 :]:
                        both = gain + sizes[other]
                        if best < both <= space:
                            best, step = both, ([i], [j, other])
        if step is None:
            return 0
        out, into = step
        self.bins[taker] = [i for i in mine if i not in out] + into
        self.bins[giver] = [j for j in theirs if j not in into] + out
        self.fill[taker] += best
        self.fill[giver] -= best
        return 1


def pack(sizes: list[int], room: int) -> list[list[int]]:
    return Search(sizes, best_fit(sizes, room), room).run()


def assignments(pieces: DataFrame, length: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``uid, sequence_id, offset`` of every piece of ``uid, length``."""
    full = pieces.where(F.col("length") == length).select(
        "uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    rest = saved(pieces.where(F.col("length") < length).select("uid", "length"), "rests")
    found = full
    schema = "uid bigint, length bigint, sequence_id bigint, offset bigint, fill bigint"
    left = rest.count()
    for turn in range(ROUNDS):
        groups = max(1, -(-left // group_pieces))
        seed = F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(groups)).cast("int")
        dealt = rest.withColumn("group", seed).repartitionById(groups, "group")
        packed = saved(dealt.groupBy("group").applyInPandas(group_packer(length, turn), schema), "packed")
        good = F.col("fill") >= WELL_FILLED * length
        bad = packed.where(~good)
        before, left = left, bad.count()
        if groups == 1 or turn == ROUNDS - 1 or not left or left > 0.9 * before:
            break
        found = found.union(packed.where(good).select("uid", "sequence_id", "offset"))
        rest = bad.select("uid", "length")
    return found.union(packed.select("uid", "sequence_id", "offset"))


def group_packer(length: int, turn: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "uid"])
        sizes, uids = pdf.length.tolist(), pdf.uid.to_numpy()
        first = turn << 56 | int(pdf.group.iloc[0]) << 24
        rows = []
        for n, members in enumerate(pack(sizes, length)):
            at, fill = 0, sum(sizes[i] for i in members)
            for i in members:
                rows.append((uids[i], sizes[i], first | n, at, fill))
                at += sizes[i]
        return pd.DataFrame(rows, columns=["uid", "length", "sequence_id", "offset", "fill"])

    return run


def packed_sequences(docs: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id") -> DataFrame:
    """Every piece with its ids, ``sequence_id`` and ``offset`` there."""
    pieces = token_pieces(docs, tokenizer, length, id_col=id_col)
    return pieces.join(assignments(pieces.select("uid", "length"), length), "uid").drop("uid")
