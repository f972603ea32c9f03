"""Token ids of a corpus in compressed binary files, in document order.

Documents are sorted by id into shards (boundaries come from the ids alone), encoded with a
public tokenizer, ended by ``END`` and written as one file per shard. A file is a row of
coded blocks and a table of its documents:

    magic "TOKF" | number of blocks, number of documents, bytes of the document table (8 each)
    document table (deflated): ids (8 bytes), null marks (1), lengths (8), column by column
    blocks, see ``id_coder``

Blocks hold ``BLOCK_IDS`` ids across document borders and can be read apart.

Null texts are empty: such a document is its end id. Null ids come first. Rows with equal
ids follow each other, the smaller text first.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfrank.llm import id_coder
from shelfrank.llm.common import pieces_of, saved, shard_of, text_blocks
from shelfrank.llm.store import MANIFEST, NewFile, commit, manifest_batch, one_task_each, opened, read_manifest
from shelfrank.llm.tokens import encoder

MAGIC = b"TOKF"
HEAD = struct.Struct("<4sQQQ")
END = 0
SHARD_BYTES = 16 << 20


def file_bytes(ids: list[int | None], lengths: list[int], tokens: np.ndarray) -> bytes:
    blocks = [
        tokens[i : i + id_coder.BLOCK_IDS] for i in range(0, len(tokens), id_coder.BLOCK_IDS)
    ]
    table = np.array([0 if i is None else i for i in ids], "<i8").tobytes()
    table += np.array([i is None for i in ids], "u1").tobytes()
    table = zlib.compress(table + np.array(lengths, "<i8").tobytes())
    coded = id_coder.encode(blocks)
    return HEAD.pack(MAGIC, len(coded), len(ids), len(table)) + table + b"".join(coded)


def read_file(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, lengths and all token ids of a file."""
    magic, n_blocks, n_docs, size = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEAD.size + size
    table = zlib.decompress(data[HEAD.size : at])
    ids = np.frombuffer(table, "<i8", n_docs).astype(object)
    ids[np.frombuffer(table, "u1", n_docs, 8 * n_docs) == 1] = None
    lengths = np.frombuffer(table, "<i8", n_docs, 9 * n_docs)
    blocks = []
    for _ in range(n_blocks):
        _, payload, _ = id_coder.HEAD.unpack_from(data, at)
        end = at + id_coder.HEAD.size + payload
        blocks.append(data[at:end])
        at = end
    tokens = np.concatenate([np.zeros(0, np.uint32), *id_coder.decode(blocks)])
    if lengths.sum() != len(tokens):
        raise ValueError("documents and blocks of a token file differ in length")
    return list(ids), lengths, tokens


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end: int = END, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Files with the ids of all rows in ``folder``; returns the manifest (records: ids)."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1
    sizes = saved(docs.select("doc_id", size.alias("size")), "text-sizes")
    bounds = pieces_of(sizes, "doc_id", "size", shard_bytes)
    rows = docs.select("doc_id", "text").withColumn("shard", shard_of(bounds)("doc_id"))
    dealt = rows.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions(
        "shard", "doc_id", "text"
    )
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        done, shard, ids, parts = [], None, [], []

        def finish():
            file = NewFile(folder, f"{shard:08d}.tok")
            tokens = np.frombuffer(b"".join(parts), "<u4")
            lengths = [len(p) // 4 for p in parts]
            file.write(file_bytes(ids, lengths, tokens), len(tokens))
            done.append(file.close())

        code = encoder(tokenizer)
        for rows, texts in text_blocks(batches, ["doc_id", "shard"], "text"):
            coded = code.encode([t.decode() for t in texts])
            for (doc, own), data in zip(rows, coded, strict=True):
                if own != shard:
                    if ids:
                        finish()
                    shard, ids, parts = own, [], []
                ids.append(doc)
                parts.append(data + last)
        if ids:
            finish()
        yield manifest_batch(done)

    return commit(dealt.mapInArrow(run, MANIFEST), folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, in the files' order of ``start``.

    ``ids`` are little-endian unsigned 32-bit integers; ``start`` counts the ids before.
    """
    before = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    files = read_manifest(spark, folder).withColumn(
        "base", F.coalesce(F.sum("records").over(before), F.lit(0))
    )

    def run(batches):
        store, root = opened(folder)
        for batch in batches:
            for name, base in zip(*(batch.column(c).to_pylist() for c in ("name", "base")), strict=True):
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    ids, lengths, tokens = read_file(stream.read())
                ends = np.cumsum(lengths)
                data = tokens.astype("<u4").tobytes()
                bodies = [data[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(base + ends - lengths),
                        pa.array(lengths),
                        pa.array(bodies, pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    return one_task_each(files.select("name", "base")).mapInArrow(run, schema)
