"""Counts, weights and block rows of terms, on Arrow batches with one row per item.

Spark places the rows, joins and aggregates over items; the functions here turn the rows of a
batch. An item's terms stay arrays of one row until the tables are written, so nothing sorts
or hashes single terms of an item.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

# Batch functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Tokens or terms of about so many are turned at once.
SLICE = 400_000
COUNTS = "term array<string>, tf_content array<int>, tf_opinion array<int>"
WEIGHTS = "w_content array<double>, w_opinion array<double>"
BLOCKS = (
    "block bigint, part int, best_quality double, term array<string>, "
    "cells array<array<struct<item_id:{item},c:double,o:double>>>"
)


def _sizes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[i] .. starts[i] + sizes[i] - 1``, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _lists(starts: np.ndarray, values, kind: pa.DataType | None = None) -> pa.ListArray:
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values)


def _slices(batch: pa.RecordBatch, names: list[str]):
    """Parts of a batch with about ``SLICE`` values in its lists."""
    load = np.cumsum(sum(_sizes(batch.column(n)) for n in names))
    start = 0
    while start < batch.num_rows:
        before = load[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(load, before + SLICE, side="right")))
        yield batch.slice(start, end - start)
        start = end


def _coded(columns: list[pa.Array]) -> tuple[np.ndarray, pa.Array]:
    """Numbers of all values of all lists, and what they stand for."""
    values = pa.concat_arrays([c.flatten().cast(pa.string()) for c in columns]).dictionary_encode()
    return values.indices.to_numpy().astype(np.int64), values.dictionary


def _counted(batch: pa.RecordBatch, recipes: list[tuple]) -> list[pa.Array]:
    """Words and pairs of neighbours of both recipes: terms and their two counts per row."""
    names = sorted({name for recipe in recipes for name, _ in recipe})
    columns = {n: batch.column(f"tok_{n}") for n in names}
    ids, words = _coded(list(columns.values()))
    sizes = {n: _sizes(c) for n, c in columns.items()}
    bases = _starts(np.array([sizes[n].sum() for n in names]))
    first = {n: base + _starts(sizes[n])[:-1] for n, base in zip(names, bases, strict=False)}
    # A word is its number, a pair that of its first word, from 1, times all words, plus the second.
    span = np.int64((len(words) + 1) * max(len(words), 1))
    keys = []
    for kind, recipe in enumerate(recipes):
        blocks = [name for name, times in recipe for _ in range(times)]
        lengths = np.stack([sizes[b] for b in blocks], axis=1)
        line = ids[_ranges(np.stack([first[b] for b in blocks], axis=1).ravel(), lengths.ravel())]
        row = np.repeat(np.arange(batch.num_rows), lengths.sum(axis=1))
        together = row[1:] == row[:-1]
        pairs = (line[:-1] + 1) * len(words) + line[1:]
        keys.append(((row * span + line) << 1) | kind)
        keys.append(((row[1:] * span + pairs)[together] << 1) | kind)
    keys = np.concatenate(keys)
    keys.sort()
    heads = np.flatnonzero(np.diff(keys >> 1, prepend=-1))
    total = np.diff(np.append(heads, len(keys)))
    second = np.add.reduceat(keys & 1, heads) if len(heads) else total
    row, code = np.divmod(keys[heads] >> 1, span)
    last = code % max(len(words), 1)
    before = code // max(len(words), 1) - 1
    lead = pa.array(np.maximum(before, 0), mask=before < 0)
    # A blank stands between the words of a pair and before no single word.
    term = pc.binary_join_element_wise(words.take(lead), words.take(pa.array(last)), " ", null_handling="skip")
    starts = np.searchsorted(row, np.arange(batch.num_rows + 1))
    return [_lists(starts, term), _lists(starts, total - second, pa.int32()), _lists(starts, second, pa.int32())]


def item_counts(tokens: DataFrame, keys: list[str], recipes: list[tuple]) -> DataFrame:
    """``keys, term, tf_content, tf_opinion`` of each row of ``tokens`` (``keys, tok_*``), as arrays."""
    schema = StructType([tokens.schema[k] for k in keys]).simpleString()[len("struct<"):-1]
    fields = [c for c in tokens.columns if c not in keys]

    def run(batches):
        for batch in batches:
            for part in _slices(batch, fields):
                columns = [part.column(k) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [*columns, *_counted(part, recipes)], [*keys, "term", "tf_content", "tf_opinion"]
                )

    return tokens.select(*keys, *fields).mapInArrow(run, f"{schema}, {COUNTS}")


def _unit(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each row divided by its length; a row of zeros stays."""
    squares = np.zeros(len(sizes), np.longdouble)
    filled = np.flatnonzero(sizes)
    if len(filled):
        # Extended precision, so that equal rows in another order give one length.
        squares[filled] = np.add.reduceat(np.square(values.astype(np.longdouble)), _starts(sizes)[filled])
    norm = np.repeat(np.sqrt(squares.astype(np.float64)), sizes)
    return np.divide(values, norm, out=np.zeros_like(values), where=norm > 0)


def item_weights(counts: DataFrame, terms: list[str], idf: dict[str, list[float]]) -> DataFrame:
    """``item_counts`` of the vocabulary's terms only, with ``w_* = tf * idf / row norm``.

    ``idf`` has a number per term of ``terms``, 0 where a kind doesn't know it.
    """
    schema = counts.schema.simpleString()[len("struct<"):-1]
    names = ["term", "tf_content", "tf_opinion"]

    def run(batches):
        known = pa.array(terms, pa.string())
        by_kind = [np.array(idf["content"], np.float64), np.array(idf["opinion"], np.float64)]
        for batch in batches:
            for part in _slices(batch, ["term"]):
                sizes = _sizes(part.column("term"))
                row = np.repeat(np.arange(part.num_rows), sizes)
                flat = [part.column(n).flatten() for n in names]
                place = pc.index_in(flat[0].cast(pa.string()), known)
                keep = place.is_valid().to_numpy(zero_copy_only=False)
                place = place.drop_null().to_numpy()
                sizes = np.bincount(row[keep], minlength=part.num_rows)
                starts = _starts(sizes)
                tfs = [x.to_numpy()[keep] for x in flat[1:]]
                weights = [_unit(tf * values[place], sizes) for tf, values in zip(tfs, by_kind, strict=True)]
                new = {
                    "term": _lists(starts, known.take(pa.array(place))),
                    "tf_content": _lists(starts, tfs[0], pa.int32()),
                    "tf_opinion": _lists(starts, tfs[1], pa.int32()),
                }
                columns = [new.get(n, part.column(n)) for n in part.schema.names]
                yield pa.RecordBatch.from_arrays(
                    [*columns, *[_lists(starts, w, pa.float64()) for w in weights]],
                    [*part.schema.names, "w_content", "w_opinion"],
                )

    return counts.mapInArrow(run, f"{schema}, {WEIGHTS}")


def _block_rows(table: pa.Table, parts: int) -> pa.RecordBatch:
    """Whole blocks by (block, part), with the terms of each as arrays."""
    table = table.combine_chunks()
    column = {n: table.column(n).chunk(0) for n in table.column_names}
    sizes = _sizes(column["term"])
    ids, terms = _coded([column["term"]])
    row = np.repeat(np.arange(table.num_rows), sizes)
    blocks, place = np.unique(column["block"].to_numpy(), return_inverse=True)
    part = np.array([zlib.crc32(t.encode()) % parts for t in terms.to_pylist()], np.int64)
    key = (place[row] * parts + part[ids]) * max(len(terms), 1) + ids
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    heads = np.flatnonzero(np.diff(key, prepend=-1))
    weights = [column[n].flatten().to_numpy()[order] for n in ("w_content", "w_opinion")]
    quality = np.full(len(blocks), -np.inf)
    np.maximum.at(quality, place, column["quality_score"].to_numpy(zero_copy_only=False))
    group, term = np.divmod(key[heads], max(len(terms), 1))
    tops = np.flatnonzero(np.diff(group, prepend=-1))
    block, part = np.divmod(group[tops], parts)
    ends = np.append(tops, len(heads))
    cells = pa.StructArray.from_arrays(
        [column["item_id"].take(pa.array(row)), *map(pa.array, weights)], ["item_id", "c", "o"]
    )
    return pa.RecordBatch.from_arrays(
        [
            pa.array(blocks[block]), pa.array(part, pa.int32()), pa.array(quality[block]),
            _lists(ends, terms.take(pa.array(term))), _lists(ends, _lists(np.append(heads, len(key)), cells)),
        ],
        ["block", "part", "best_quality", "term", "cells"],
    )


def block_rows(placed: DataFrame, parts: int) -> DataFrame:
    """A row per block and part of its terms (``crc32`` modulo ``parts``) from rows ``block, item_id, quality_score, term, w_*`` of items.

    Rows of a block must lie side by side.
    """
    names = ["block", "item_id", "quality_score", "term", "w_content", "w_opinion"]
    item = placed.schema["item_id"].dataType.simpleString()

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            for part in _slices(batch, ["term"]):
                table = pa.Table.from_batches([part])
                table = table if held is None else pa.concat_tables([held, table])
                block = table.column("block").to_numpy()
                # The last block may go on.
                cut = int(np.argmax(block == block[-1]))
                if cut:
                    yield _block_rows(table.slice(0, cut), parts)
                held = table.slice(cut)
        if held is not None:
            yield _block_rows(held, parts)

    return placed.select(*names).mapInArrow(run, BLOCKS.format(item=item))


# Scores of items and requests held at once by a task, and what a sum in another order may lose.
GRID = 2_000_000
SLACK = 1e-8


def term_lists(terms: pa.Table, limits: pa.Table | None) -> dict:
    """Lists of the requests of each term, and what bounds a request's pairs.

    ``terms``: request_id, term, qc, qo. ``limits``: request_id, content, opinion, least_opinion,
    quality (weights) and floor; requests it lacks have no floor.
    """
    requests = terms.column("request_id").combine_chunks().dictionary_encode(null_encoding="encode")
    words = terms.column("term").combine_chunks().dictionary_encode()
    place = words.indices.to_numpy().astype(np.int64)
    order = np.argsort(place, kind="stable")
    found = {
        "requests": requests.dictionary,
        "terms": words.dictionary,
        "starts": np.searchsorted(place[order], np.arange(len(words.dictionary) + 1)),
        "request": requests.indices.to_numpy().astype(np.int64)[order],
    }
    for name in ("qc", "qo"):
        found[name] = pc.fill_null(terms.column(name).combine_chunks(), 0.0).to_numpy(zero_copy_only=False)[order]
    if limits is not None:
        at = pc.index_in(requests.dictionary, limits.column("request_id").combine_chunks())
        for name in ("content", "opinion", "least_opinion", "quality", "floor"):
            values = limits.column(name).combine_chunks().take(at)
            found[name] = pc.fill_null(values, -10.0 if name == "floor" else 1.0).to_numpy(zero_copy_only=False)
    return found


def _grid(part: pa.RecordBatch, lists: dict) -> tuple[np.ndarray, np.ndarray]:
    """Sums of content and opinion products of each item with each request."""
    place = pc.index_in(part.column("term").flatten().cast(pa.string()), lists["terms"])
    known = place.is_valid().to_numpy(zero_copy_only=False)
    place = place.drop_null().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(part.num_rows), _sizes(part.column("term")))[known]
    weights = [part.column(n).flatten().to_numpy()[known] for n in ("w_content", "w_opinion")]
    sums = [np.zeros((part.num_rows, len(lists["requests"]))) for _ in weights]
    bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
    for item in np.flatnonzero(np.diff(bounds)):
        own = slice(bounds[item], bounds[item + 1])
        first = lists["starts"][place[own]]
        sizes = lists["starts"][place[own] + 1] - first
        at = _ranges(first, sizes)
        request = lists["request"][at]
        for out, weight, name in zip(sums, weights, ("qc", "qo"), strict=True):
            values = lists[name][at] * np.repeat(weight[own], sizes)
            out[item] = np.bincount(request, weights=values, minlength=out.shape[1])
    return sums[0], sums[1]


def asked_lists(files: list[str]) -> Iterator[dict]:
    """``term_lists`` of groups of requests, a group per file.

    A file has the rows of both tables: those of ``limits`` have no term.
    """
    for file in files:
        store, path = fs.FileSystem.from_uri(file)
        with store.open_input_file(path) as source:
            table = pq.ParquetFile(source).read()
        is_term = table.column("term").is_valid()
        terms, limits = table.filter(is_term), table.filter(pc.invert(is_term))
        if len(terms):
            yield term_lists(terms, limits if len(limits) else None)


def request_pairs(
    rows: DataFrame, lists, request: str, bounded: bool, depth: int = 0, kept: tuple[str, ...] = (),
    counted: dict | None = None,
) -> DataFrame:
    """``request_id, item_id, content_score, opinion_raw`` of items that share a term.

    ``rows``: item_id, quality_score, term, w_*, one per item; ``lists``: broadcast ``term_lists``
    or the files of ``asked_lists``, which a task reads one after the other; ``request``: the type
    of their ids.
    With ``bounded``, pairs that can't reach their request's floor are left out; with ``depth``,
    also those that a task finds to be no more among the ``depth`` best by their least score.
    ``kept`` columns of an item go with its pairs. ``counted``: the place of each request in the
    items' array ``found``, of which each pair gets its number.
    """
    item = rows.schema["item_id"].dataType.simpleString()
    more = StructType([rows.schema[c] for c in kept]).simpleString()[len("struct<"):-1]
    added = [*([more] if kept else []), *(["found int"] if counted is not None else [])]

    def taken(batch, asked, at, asker, content, opinion):
        place = pa.array(at)
        columns = [
            asked["requests"].take(pa.array(asker)), batch.column("item_id").take(place),
            pa.array(content), pa.array(opinion), *[batch.column(c).take(place) for c in kept],
        ]
        names = ["request_id", "item_id", "content_score", "opinion_raw", *kept]
        if counted is not None:
            places = np.array([counted[r] for r in asked["requests"].to_pylist()], np.int64)
            found = batch.column("found")
            first = found.offsets.to_numpy()[:-1].astype(np.int64)[at]
            columns.append(found.values.take(pa.array(first + places[asker])))
            names.append("found")
        return pa.RecordBatch.from_arrays(columns, names)

    def scored(batch, asked, best):
        """Pairs of a batch and a group; ``best`` has the group's best least scores so far."""
        n = len(asked["requests"])
        height = max(1, GRID // max(n, 1))
        held: list[list[np.ndarray]] = []
        for start in range(0, batch.num_rows, height):
            part = batch.slice(start, height)
            content, opinion = _grid(part, asked)
            keep = (content > 0) | (opinion > 0)
            quality = part.column("quality_score").to_numpy(zero_copy_only=False)[:, None]
            if bounded:
                high = content * asked["content"] + opinion * asked["opinion"] + quality * asked["quality"]
                keep &= high >= asked["floor"] - SLACK
            if depth:
                low = content * asked["content"] + opinion * asked["least_opinion"] + quality * asked["quality"]
                low[~keep] = -np.inf
                both = np.concatenate([best, low])
                best[:] = np.partition(both, len(both) - depth, axis=0)[len(both) - depth:]
                keep &= low >= best.min(axis=0) - SLACK
            at, asker = np.nonzero(keep)
            found = [start + at, asker, content[at, asker], opinion[at, asker]]
            if not depth:
                yield taken(batch, asked, *found)
                continue
            # Most of a batch's first pairs are among the best for a while only.
            held.append([*found, low[at, asker]])
            last = start + height >= batch.num_rows
            if last or sum(len(h[0]) for h in held) > 2 * GRID:
                *found, least = (np.concatenate(x) for x in zip(*held, strict=True))
                still = least >= best.min(axis=0)[found[1]] - SLACK
                yield taken(batch, asked, *[x[still] for x in found])
                held = []

    def run(batches):
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            for group, asked in enumerate(asked_lists(lists) if isinstance(lists, list) else [lists.value]):
                if depth and group not in best:
                    best[group] = np.full((depth, len(asked["requests"])), -np.inf)
                yield from scored(batch, asked, best.get(group))

    names = ["item_id", "quality_score", "term", "w_content", "w_opinion"]
    names += [c for c in kept if c not in names] + (["found"] if counted is not None else [])
    schema = f"request_id {request}, item_id {item}, content_score double, opinion_raw double"
    return rows.select(*names).mapInArrow(run, ", ".join([schema, *added]))
