"""Best-two-fit packing of tokenised documents into sequences of bounded length.

A sequence is filled greedily with the largest piece that still fits. When none fits, its smallest piece is
replaced by the two unpacked pieces that fill the widened gap most tightly, as long as that leaves less room.

Pieces are tokenised where the texts lie; only a narrow row for each (length, checksum) moves. They are
dealt at random to shards of bounded size which are packed on their own; at most the last sequence of a
shard stays half empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.bpe import Encoder, default_vocabulary
from pagemill.llm.shared import stored

LENGTH, END_ID, SHARD_PIECES = 2048, 0, 200_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, document long"


def cuts(tokens: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones at its end, what is left over first."""
    first = tokens % length
    starts = ([0] if first else []) + list(range(first, tokens, length))
    return [(a, (first if k == 0 and first else length)) for k, a in enumerate(starts)]


def encoded(texts: pa.Array, path: str, end_id: int | None, literals: bool = False) -> Iterator[tuple[int, bytes]]:
    """(row, little-endian unsigned 32-bit ids) of whole texts, a few MB of text at a time."""
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    encoder, at, n = Encoder.get(path, literals), 0, len(texts)
    while at < n:
        some, held = [], 0
        while at + len(some) < n and held < 4 << 20:
            some.append(texts[at + len(some)].as_py())
            held += len(some[-1] or "")
        for k, ids in enumerate(encoder.encode(some)):
            yield at + k, ids + end
        at += len(some)


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False, literals: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, document[, ids]) of (doc_id, text); a null text is an empty one and has the end id only.

    ``document`` numbers the rows, so that pieces of rows that share an id can be told apart.
    """
    path = path or default_vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document = TaskContext.get().partitionId() << 33
        for batch in batches:
            names, rows = batch.column("doc_id").to_pylist(), []
            for k, ids in encoded(batch.column("text"), path, end_id, literals):
                for nr, (start, n) in enumerate(cuts(len(ids) // 4, length)):
                    data = ids[4 * start : 4 * (start + n)]
                    rows.append((names[k], nr, start, n, zlib.crc32(data), document + k, *([data] if with_ids else [])))
                    if len(rows) >= 10_000:  # within a document too, however long it is
                        yield _batch(rows, with_ids)
                        rows = []
            if rows:
                yield _batch(rows, with_ids)
            document += batch.num_rows

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, _PIECES + (", ids binary" if with_ids else ""))


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "document", *(["ids"] if with_ids else [])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


class _Unpacked:
    """Pieces by length, with the largest length at most x in nearly constant time."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        order = np.argsort(lengths, kind="stable")
        ends = np.searchsorted(lengths[order], np.arange(capacity + 2))
        self.rows = [order[ends[n] : ends[n + 1]].tolist() for n in range(capacity + 1)]
        self.below = [n if self.rows[n] else n - 1 for n in range(capacity + 1)]  # 0 stands for none
        self.below[0] = 0

    def largest(self, most: int) -> int:
        """The largest length at most ``most`` that has a piece; 0 if there is none."""
        below, x = self.below, most
        while below[x] != x:
            below[x] = below[below[x]]
            x = below[x]
        return x

    def take(self, length: int) -> int:
        row = self.rows[length].pop()
        if not self.rows[length]:
            self.below[length] = length - 1
        return row

    def give_back(self, length: int, row: int) -> None:
        self.rows[length].append(row)
        if len(self.rows[length]) == 1:  # shortened paths may have skipped it
            below = self.below
            below[length] = length
            for x in range(length + 1, len(below)):
                if self.rows[x]:
                    break
                below[x] = max(below[x], length) if below[x] < length else below[x]

    def best_pair(self, least: int, most: int) -> tuple[int, int] | None:
        """Two pieces whose lengths sum to more than ``least`` and at most ``most``, as much as possible."""
        found, best = None, least
        a = self.largest(most - 1) if most > 1 else 0
        while a and 2 * a > best:  # the other isn't longer
            b = self.largest(min(most - a, a))
            if b == a and len(self.rows[a]) < 2:
                b = self.largest(a - 1)
            if b and a + b > best:
                found, best = (a, b), a + b
                if best == most:
                    break
            a = self.largest(a - 1)
        return found


def pack(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length of 1 to ``capacity``."""
    lengths = np.asarray(lengths, np.int64)
    if len(lengths) and not 1 <= lengths.min() <= lengths.max() <= capacity:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    rest = _Unpacked(lengths, capacity)
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    nr = 0
    while first := rest.largest(capacity):
        inside = [(first, rest.take(first))]
        gap = capacity - first
        while True:
            while gap and (n := rest.largest(gap)):
                inside.append((n, rest.take(n)))
                gap -= n
            smallest, row = inside[-1]  # they came in falling order
            pair = rest.best_pair(smallest, smallest + gap) if gap else None
            if pair is None:
                break
            inside.pop()
            inside += [(n, rest.take(n)) for n in pair]
            inside.sort(key=lambda x: -x[0])
            rest.give_back(smallest, row)
            gap += smallest - sum(pair)
        at = 0
        for n, k in inside:
            sequence[k], offset[k] = nr, at
            at += n
        nr += 1
    return sequence, offset


def _pack_shard(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sequence, offset = pack(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=(np.int64(pdf["shard"].iloc[0]) << 40) + sequence, offset=offset).drop(columns="shard")

    return run


def packed(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES, with_ids: bool = False, literals: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, document[, ids], sequence_id, offset): all pieces and their places.

    Null and empty texts are a piece of one token; only texts of more than ``length`` ids are cut, however long.
    Repeated rows, and rows that share an id, are documents of their own, as ``document`` shows. An empty table gives no rows; columns besides doc_id and text play no part. ``literals``: as in ``bpe``.
    """
    rows = stored(pieces(docs, path, length, end_id, with_ids, literals), "pieces")
    shards = max(1, -(-rows.count() // shard_pieces))
    # by row number: rows that are alike in everything spread as well
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    schema = _PIECES + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"
    return dealt.groupBy("shard").applyInPandas(_pack_shard(length), schema)
