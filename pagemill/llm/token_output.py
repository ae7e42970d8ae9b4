"""Token-id output: best-fit-decreasing packing into id matrices in binary files.

Each task packs the documents it reads: it gathers ids up to a bounded number of tokens, packs them by falling
length into the fullest row that still has room, found in a segment tree over free room, and writes a
file. No ids are shuffled. Files have random names in a shared folder and a row each in a manifest; only files
of the manifest are read, so a repeated or lost task leaves files that nobody reads.

A file is a numpy archive: ``ids`` (rows, length) filled up with the end id, ``positions`` (rows, length) that
start anew at 0 with each segment, ``cu_seqlens`` with the cumulative lengths of each row's segments, each row
from 0, ``row_starts`` where each row begins in it, and for each segment ``doc_id``, ``has_id``, ``piece``, ``start``.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.best_two_fit import END_ID, LENGTH, encoded
from pagemill.llm.bpe import default_vocabulary
from pagemill.llm.shared import shared_folder, stored

FILE_TOKENS, MOST_TASKS = 4 << 20, 20_000
_FILES = "path string, number long, rows long, tokens long"
_SEGMENTS = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, positions_reset boolean"


class RoomTree:
    """Rows by free room; a segment tree finds the least room of at least n that any row has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, row) with the least room of at least ``least``; it leaves the tree."""
        node, count = least + self.leaves, self.count
        if not count[node]:
            while True:  # up to the first right neighbour that holds a row
                while node & 1:
                    node >>= 1
                if not node:
                    return None
                node += 1
                if count[node]:
                    break
                node >>= 1
                if node <= 1:
                    return None
            while node < self.leaves:  # down to its first leaf
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, offset) of each length of 1 to ``capacity``, and how many rows there are."""
    row, offset, tree, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), RoomTree(capacity), 0
    for k in np.argsort(-np.asarray(lengths, np.int64), kind="stable").tolist():
        size = int(lengths[k])
        got = tree.take(size)
        if got is None:
            got, n = (capacity, n), n + 1
        row[k], offset[k] = got[1], capacity - got[0]
        tree.add(got[0] - size, got[1])
    return row, offset, n


def split(tokens: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: full ones first, the rest last; nothing is lost."""
    return [(a, min(length, tokens - a)) for a in range(0, tokens, length)]


def archive(segments: list[tuple[int | None, int, int, bytes]], length: int, fill: int) -> tuple[bytes, int]:
    """The file of (doc_id, piece, start, ids) and its number of rows."""
    lengths = np.array([len(s[3]) // 4 for s in segments], np.int64)
    row, offset, n = best_fit_decreasing(lengths, length)
    order = np.lexsort((offset, row))
    flat = np.frombuffer(b"".join(segments[k][3] for k in order), "<u4")
    size, at = lengths[order], row[order] * length + offset[order]
    inside = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    places = np.repeat(at, size) + inside
    kind = np.uint16 if max(fill, int(flat.max(initial=0))) < 1 << 16 else np.uint32
    ids = np.full(n * length, fill, kind)
    ids[places] = flat
    positions = np.zeros(n * length, np.uint16 if length <= 1 << 16 else np.uint32)
    positions[places] = inside
    counts = np.bincount(row, minlength=n) + 1  # a leading 0 and the ends of its segments
    row_starts = np.concatenate(([0], np.cumsum(counts)))
    cumulative = np.zeros(int(row_starts[-1]), np.int32)
    slots = np.arange(len(order)) + row[order] + 1
    cumulative[slots] = offset[order] + size
    out = io.BytesIO()
    np.savez(
        out, ids=ids.reshape(n, length), positions=positions.reshape(n, length), cu_seqlens=cumulative, row_starts=row_starts,
        doc_id=np.array([segments[k][0] or 0 for k in order], np.int64), has_id=np.array([segments[k][0] is not None for k in order], bool),
        piece=np.array([segments[k][1] for k in order], np.int32), start=np.array([segments[k][2] for k in order], np.int64),
    )
    return out.getvalue(), n


def write_matrices(docs: DataFrame, folder: str | None = None, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, file_tokens: int = FILE_TOKENS, literals: bool = False) -> DataFrame:
    """Files for (doc_id, text) as (path, number, rows, tokens); ``number`` is unique. A null text is an empty one and has the end id only.

    Rows that repeat or share an id are documents of their own; no rows give no files. Other columns play no part.
    A very long text is split without loss, and may go on in the next file.
    ``literals``: as in ``bpe``.
    """
    folder, path = folder or shared_folder(docs.sparkSession, "tokens"), path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        held, tokens, nr, task = [], 0, 0, TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            data, n = archive(held, length, end_id)
            name = f"{uuid.uuid4().hex}.npz"
            with store.open_output_stream(f"{top}/{name}", compression=None) as out:
                out.write(data)
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "number": (task << 20) + nr, "rows": n, "tokens": tokens}])

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for k, ids in encoded(batch.column("text"), path, end_id, literals):
                for piece, (a, n) in enumerate(split(len(ids) // 4, length)):
                    held.append((names[k], piece, a, ids[4 * a : 4 * (a + n)]))
                    tokens += n
                    if tokens >= file_tokens:
                        yield flush()
                        held, tokens, nr = [], 0, nr + 1
        if held:
            yield flush()

    return stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _FILES), "manifest")


def read_matrices(files: DataFrame) -> DataFrame:
    """The segments of the files, with the checksum of the ids that were read and whether their positions count up from 0.

    Null ids come back as null; texts that share an id, repeated ones too, as segments of their own; no files give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, number in zip(batch.column("path").to_pylist(), batch.column("number").to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as f:
                    z = np.load(io.BytesIO(f.read()))
                ids, positions, ends, starts = z["ids"], z["positions"], z["cu_seqlens"], z["row_starts"]
                rows, k = [], 0
                docs, known, piece, begin = z["doc_id"].tolist(), z["has_id"].tolist(), z["piece"].tolist(), z["start"].tolist()
                up = np.arange(ids.shape[1])
                for r in range(len(ids)):
                    cuts = ends[starts[r] : starts[r + 1]].tolist()
                    for a, b in zip(cuts, cuts[1:], strict=False):
                        crc = zlib.crc32(ids[r, a:b].astype("<u4").tobytes())
                        rows.append((docs[k] if known[k] else None, piece[k], begin[k], b - a, crc, (number << 24) + r, a, bool((positions[r, a:b] == up[: b - a]).all())))
                        k += 1
                types = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in _SEGMENTS.split(", ")])

    # a stated number of tasks, as Spark would put rows this small into one
    return files.repartition(max(1, min(MOST_TASKS, files.count()))).mapInArrow(run, _SEGMENTS)
