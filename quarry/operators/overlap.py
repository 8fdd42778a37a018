"""Shared tokens of many pairs of texts: sketches that bound them from above, and exact counts in batches."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import tokens

#: Tokens fall into so many buckets.
BUCKETS = 4096
#: Pairs handled at once.
PAIRS = 4096
#: Scores are rounded to 6 places before they are compared.
SLACK = 1e-6
#: Bytes of a sketch: a step to the next bucket that has a token; from _AGAIN on so many more tokens of that bucket; _MORE, a step without a token.
_AGAIN, _MORE = 200, 255


def _coded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and code of each token of a column of lists, and the tokens by code."""
    flat = pc.list_flatten(lists).dictionary_encode()
    return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary.to_numpy(zero_copy_only=False)


def _packed(row: np.ndarray, bucket: np.ndarray, n: int) -> pa.Array:
    """The buckets of each of n rows in ascending order, with their numbers of tokens, as one byte string a row."""
    key, count = _counted(np.sort(row * BUCKETS + bucket))
    row, bucket = key // BUCKETS, key % BUCKETS
    first = np.ones(len(key), bool)
    first[1:] = row[1:] != row[:-1]
    step, more = bucket - np.where(first, 0, np.roll(bucket, 1)), count - 1
    most = _MORE - _AGAIN
    skips, repeats = step // _AGAIN, -(-more // most)
    width = skips + 1 + repeats
    end = np.cumsum(width)
    at = np.repeat(end - width, width)
    place, skip, repeat = np.arange(int(width.sum())) - at, np.repeat(skips, width), np.repeat(repeats, width)
    out = np.where(place < skip, _MORE, np.where(place == skip, np.repeat(step % _AGAIN, width), _AGAIN + most - 1)).astype(np.uint8)
    last = (place == skip + repeat) & (repeat > 0)
    out[last] = (_AGAIN + (more - 1) % most)[repeats > 0]
    ends = np.zeros(n + 1, np.int32)
    ends[1:] = np.cumsum(np.bincount(row, width, n))
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(out.tobytes())])


def _unpacked(sketches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys, row * BUCKETS + bucket in ascending order, and how many tokens each has."""
    sketches = pa.concat_arrays([sketches.cast(pa.binary())])
    at = np.frombuffer(sketches.buffers()[1], np.int32)[sketches.offset : sketches.offset + len(sketches) + 1]
    held = np.frombuffer(sketches.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].astype(np.int64)
    row = np.repeat(np.arange(len(sketches), dtype=np.int64), np.diff(at))
    step = np.where(held < _AGAIN, held, np.where(held == _MORE, _AGAIN, 0))
    total = np.concatenate(([0], np.cumsum(step)))
    starts = np.flatnonzero(held < _AGAIN)
    key = (row * BUCKETS + total[1:] - total[at - at[0]][row])[starts]
    tokens_of = np.where(held == _MORE, 0, np.where(held < _AGAIN, 1, held - _AGAIN + 1))
    sums = np.concatenate(([0], np.cumsum(tokens_of)))
    return key, np.diff(np.append(sums[starts], sums[-1]))


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[at], np.diff(np.append(at, len(key)))


def _met(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sorted keys a are among the sorted keys b, and where."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return (b[at] == a if len(b) else np.zeros(len(a), bool)), at


def sketches(texts: DataFrame) -> DataFrame:
    """chunk_id, sketch, n, squares: the buckets of a text's tokens, its number of distinct tokens and the sum of the squares of their counts.

    texts: chunk_id, text; texts without a token are left out. A sketch has about one byte for each distinct token.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, code, words = _coded(b.column(1))
            bucket = np.fromiter((zlib.crc32(w.encode()) % BUCKETS for w in words), np.int64, len(words))
            key, n = _counted(np.sort(row * max(1, len(words)) + code))
            of = key // max(1, len(words))
            squares = np.bincount(of, n.astype(float) ** 2, b.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), _packed(row, bucket[code], b.num_rows), pa.array(np.bincount(of, minlength=b.num_rows).astype(np.int32)), pa.array(squares)], ["chunk_id", "sketch", "n", "squares"])

    kind = texts.schema["chunk_id"].dataType.simpleString()
    given = texts.select("chunk_id", tokens(F.col("text")).alias("t")).filter(F.size("t") > 0)
    return given.mapInArrow(run, f"chunk_id {kind}, sketch binary, n int, squares long")


def possible(pairs: DataFrame, held: float, cosine: float) -> DataFrame:
    """The pairs that may reach one of two bounds; those that reach one are all among them.

    pairs: any columns, sketch, n, squares, osketch, osquares. A bucket of the one text that the other lacks holds at least one token
    that it lacks, and the product of two buckets' counts is at least that of their tokens' counts.
    """
    kept = [c for c in pairs.columns if c not in ("sketch", "osketch")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, PAIRS):
                b = whole.slice(i, PAIRS)
                n, squares, osquares = (b.column(c).to_numpy(zero_copy_only=False) for c in ("n", "squares", "osquares"))
                (key, count), (okey, ocount) = _unpacked(b.column("sketch")), _unpacked(b.column("osketch"))
                hit, at = _met(key, okey)
                row = key // BUCKETS
                most = n - np.bincount(row[~hit], minlength=b.num_rows)
                dot = np.bincount(row[hit], (count * ocount[at])[hit] if len(okey) else None, b.num_rows)
                may = (n > 0) & ((most >= (held - SLACK) * n) | (dot >= (cosine - SLACK) * np.sqrt(squares.astype(float) * osquares)))
                yield b.select(kept).filter(pa.array(may))

    return pairs.mapInArrow(run, pairs.select(kept).schema)


def overlaps(pairs: DataFrame, text: str, other: str) -> DataFrame:
    """pairs, without their texts, with shared and dot: how many distinct tokens both texts have, and the product of their counts."""
    kept = [c for c in pairs.columns if c not in (text, other)]
    given = pairs.select(*kept, tokens(F.col(text)).alias("t"), tokens(F.col(other)).alias("o"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, PAIRS):
                b = whole.slice(i, PAIRS)
                row, code, words = _coded(pa.concat_arrays([b.column("t"), b.column("o")]))
                n, first = max(1, len(words)), row < b.num_rows
                (key, count), (okey, ocount) = (_counted(np.sort(k)) for k in ((row * n + code)[first], ((row - b.num_rows) * n + code)[~first]))
                hit, at = _met(key, okey)
                row = key[hit] // n
                dot = np.bincount(row, (count * ocount[at])[hit] if len(okey) else None, b.num_rows)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(np.bincount(row, minlength=b.num_rows).astype(np.int32)), pa.array(dot.astype(np.int64))], [*kept, "shared", "dot"])

    return given.mapInArrow(run, given.select(*kept, F.lit(0).alias("shared"), F.lit(0).cast("long").alias("dot")).schema)
