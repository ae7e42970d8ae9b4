"""Chroma fingerprints of audio columns, and alignment of recordings by offset histograms and bit errors.

Audio is cut into overlapping frames; each frame's spectrum is folded into twelve pitch classes. Sixteen
filters compare areas of that picture of pitch classes over time, with sums from an integral image, and give
two bits each: a 32-bit integer for each frame. Recordings that share audio share integers at one offset:
a histogram of offsets of equal integers finds it, and the differing bits of the overlapping integers at that
offset say how well they agree. Where recordings agree in a passage only, the bits of that passage count.

Searching is by blocks: a block of queries, sorted by integer, meets chunks of recordings, and each meeting
gives the recordings that align with each query. So an integer that very many recordings share, as silence
does, costs time in the task that sees it, but no rows. Equal fingerprints are one entry.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.shared import stored


@dataclass(frozen=True)
class Conf:
    frame: int = 512  # samples
    hop: int = 128
    low: float = 60.0  # Hz
    high: float = 1900.0
    width: int = 16  # frames that the widest filter sees
    least_votes: int = 4  # equal integers at the best offset; recordings of fewer than twice as many need half of theirs
    most_errors: float = 0.35  # share of differing bits at the best offset
    chunk: int = 1 << 20  # integers of recordings that meet a block
    block: int = 1 << 21  # integers of queries in a block


@dataclass(frozen=True)
class Filter:
    kind: int  # 0 halves by pitch, 1 halves by time, 2 quarters, 3 middle third by pitch, 4 middle third by time
    pitch: int
    height: int
    width: int
    step: float  # the answers -step, 0 and step bound the four values of its two bits


def filters(width: int) -> list[Filter]:
    """Sixteen filters by rule: kinds in turn, heights and places over all pitch classes, widths from narrow to wide."""
    heights = (12, 6, 8, 4, 10)
    out = []
    for k in range(16):
        height = heights[(k + k // 5) % 5]
        out.append(Filter(k % 5, (5 * k) % (12 - height + 1), height, max(3, width * (1 + k % 4) // 4), 0.15 if k % 5 else 0.3))
    return out


# The order of two-bit values in which neighbours differ in one bit.
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def samples(audio: bytes | None) -> tuple[np.ndarray, int] | None:
    """(samples from -1 to 1, rate) of PCM WAV bytes, channels averaged; None for anything else."""
    if not audio or audio[:4] != b"RIFF" or audio[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(audio):
        name, size = audio[at : at + 4], struct.unpack_from("<I", audio, at + 4)[0]
        if name == b"fmt " and size >= 16 and at + 24 <= len(audio):
            form = struct.unpack_from("<HHIIHH", audio, at + 8)
        elif name == b"data":
            if form is None or form[0] != 1 or form[5] not in (8, 16) or not form[1] or not form[2]:
                return None
            body = audio[at + 8 : at + 8 + size]
            whole = len(body) // (form[1] * form[5] // 8) * (form[1] * form[5] // 8)
            if form[5] == 8:
                x = np.frombuffer(body[:whole], np.uint8).astype(np.float32) / 128 - 1
            else:
                x = np.frombuffer(body[:whole], "<i2").astype(np.float32) / 32768
            return (x.reshape(-1, form[1]).mean(axis=1) if form[1] > 1 else x), form[2]
        at += 8 + size + size % 2
    return None


def wav(data: np.ndarray, rate: int) -> bytes:
    """8-bit mono WAV bytes of uint8 samples."""
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(data)) + data.tobytes()


class Fingerprinter:
    def __init__(self, conf: Conf = Conf()):
        self.conf, self.filters = conf, filters(conf.width)
        self.window = np.hanning(conf.frame).astype(np.float32)
        self._folds: dict[int, np.ndarray] = {}

    def _fold(self, rate: int) -> np.ndarray:
        """Which frequency belongs to which pitch class."""
        if rate not in self._folds:
            hz = np.fft.rfftfreq(self.conf.frame, 1 / rate)
            fold = np.zeros((len(hz), 12), np.float32)
            inside = np.flatnonzero((hz >= self.conf.low) & (hz <= self.conf.high))
            fold[inside, np.round(12 * np.log2(hz[inside] / 440)).astype(int) % 12] = 1
            self._folds[rate] = fold
        return self._folds[rate]

    def chroma(self, x: np.ndarray, rate: int) -> np.ndarray:
        """(frames, 12), each frame of length 1; a silent frame is zero. A short recording is filled up with silence."""
        c = self.conf
        least = c.frame + (c.width - 1) * c.hop
        if len(x) < least:
            x = np.pad(x, (0, least - len(x)))
        frames = np.lib.stride_tricks.sliding_window_view(x, c.frame)[:: c.hop]
        out = np.empty((len(frames), 12), np.float32)
        for at in range(0, len(frames), 512):  # long recordings a piece at a time
            power = np.abs(np.fft.rfft(frames[at : at + 512] * self.window, axis=1)) ** 2
            out[at : at + 512] = power.astype(np.float32) @ self._fold(rate)
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.where(norm > 1e-4, out / np.maximum(norm, 1e-4), 0)

    def integers(self, x: np.ndarray, rate: int) -> np.ndarray:
        picture = self.chroma(x, rate).astype(np.float64)
        integral = np.zeros((len(picture) + 1, 13))
        integral[1:, 1:] = picture.cumsum(axis=0).cumsum(axis=1)
        n = len(picture) - self.conf.width + 1
        out = np.zeros(n, np.uint32)

        def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
            return integral[t1 : t1 + n, p1] - integral[t0 : t0 + n, p1] - integral[t1 : t1 + n, p0] + integral[t0 : t0 + n, p0]

        parts, wholes = np.empty((2, len(self.filters), n))
        for k, f in enumerate(self.filters):
            p, q, w = f.pitch, f.pitch + f.height, f.width
            wholes[k] = area(0, w, p, q)
            if f.kind == 0:
                parts[k] = area(0, w, p + f.height // 2, q)
            elif f.kind == 1:
                parts[k] = area(w // 2, w, p, q)
            elif f.kind == 2:
                m = p + f.height // 2
                parts[k] = area(0, w // 2, p, m) + area(w // 2, w, m, q)
            elif f.kind == 3:
                parts[k] = area(0, w, p + f.height // 3, q - f.height // 3)
            else:
                parts[k] = area(w // 3, w - w // 3, p, q)
        answer = np.round(np.log1p(np.maximum(parts, 0)) - np.log1p(np.maximum(wholes - parts, 0)), 6)  # sums differ by rounding with their place
        step = np.array([[f.step] for f in self.filters])
        place = (answer > -step).astype(np.int8) + (answer > 0) + (answer > step)
        for k in range(len(self.filters)):
            out |= _GRAY[place[k]] << np.uint32(2 * k)
        return out


def fingerprints(media: DataFrame, audio: str = "audio", conf: Conf = Conf()) -> DataFrame:
    """The rows of ``media`` with ``audio`` (binary WAV) replaced by ``fp``: little-endian unsigned 32-bit integers.

    Null, empty or unreadable audio, and audio without samples, have a null fp.
    """
    rest = [c for c in media.columns if c != audio]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(conf)
        for batch in batches:
            out = []
            for value in batch.column(audio):
                got = samples(value.as_py())
                out.append(None if got is None or not len(got[0]) else maker.integers(*got).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(out, pa.binary())], names=[*rest, "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name != audio)
    return media.select(*(f"`{c}`" for c in rest), f"`{audio}`").mapInArrow(run, f"{schema}, fp binary")


def errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """(share of differing bits, integers that overlap) if b's integer k + offset stands against a's integer k."""
    lo, hi = max(0, -offset), min(len(a), len(b) - offset)
    if hi <= lo:
        return 1.0, 0
    return float(np.bitwise_count(a[lo:hi] ^ b[lo + offset : hi + offset]).mean()) / 32, hi - lo


def _starts(x: np.ndarray) -> np.ndarray:
    """Places that don't repeat the integer before: a held tone or silence votes once."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))


def _least(x: np.ndarray, starts: np.ndarray, conf: Conf) -> int:
    """The votes that a recording needs: of a short one half of those that it can give."""
    return conf.least_votes if len(x) >= 2 * conf.least_votes else min(conf.least_votes, -(-len(starts) // 2))


def stretch(a: np.ndarray, b: np.ndarray, offset: int, least: int, conf: Conf) -> tuple[float, int] | None:
    """(share of differing bits, integers) of the whole overlap, or else of a stretch of it with enough votes; None if neither agrees.

    A stretch is taken where the bits below the allowed errors add up to most; without enough votes there, what
    stands before and after it is searched.
    """
    share, overlap = errors(a, b, offset)
    if share <= conf.most_errors:
        return share, overlap
    lo = max(0, -offset)
    x, y = a[lo : lo + overlap], b[lo + offset : lo + offset + overlap]
    bits = np.bitwise_count(x ^ y).astype(np.int64)
    begun = np.intersect1d(_starts(a) - lo, _starts(b) - lo - offset)
    begun = begun[(begun >= 0) & (begun < overlap)]
    votes = np.zeros(overlap + 1, np.int64)
    votes[begun + 1] = bits[begun] == 0
    votes = votes.cumsum()
    total = np.concatenate(([0.0], (32 * conf.most_errors - bits).cumsum()))
    todo = [(0, overlap)]
    while todo:
        i, j = todo.pop()
        if j <= i or votes[j] - votes[i] < least:
            continue
        part = total[i : j + 1]
        gain = part[1:] - np.minimum.accumulate(part)[:-1]
        end = int(gain.argmax()) + 1
        begin = int(part[:end].argmin())
        if votes[i + end] - votes[i + begin] >= least:
            return float(bits[i + begin : i + end].mean()) / 32, end - begin
        todo += [(i + end, j), (i, i + begin)]
    return None


def align(queries: list[np.ndarray], others: list[np.ndarray], conf: Conf, most: int = 1 << 22) -> Iterator[tuple[int, int, int, int, float, int]]:
    """(query, other, offset, votes, errors, overlap) of pairs with enough equal integers at one offset and few bit errors.

    Of the offsets with enough votes it is the one with most that agrees; overlap counts what was judged.
    """
    places = [_starts(q) for q in queries]
    least = np.array([_least(q, p, conf) for q, p in zip(queries, places, strict=True)], np.int64)
    owner = np.repeat(np.arange(len(queries)), [len(p) for p in places])
    values = np.concatenate([q[p] for q, p in zip(queries, places, strict=True)] or [np.empty(0, np.uint32)])
    where = np.concatenate(places or [np.empty(0, np.int64)])
    order = np.argsort(values, kind="stable")
    values, owner, where = values[order], owner[order], where[order]
    span = 1 + max((len(x) for x in (*queries, *others)), default=0)
    for nr, other in enumerate(others):
        at = _starts(other)
        lo, hi = np.searchsorted(values, other[at], "left"), np.searchsorted(values, other[at], "right")
        found: list[tuple[np.ndarray, np.ndarray]] = []
        total, begin = np.cumsum(hi - lo), 0
        while begin < len(at):  # at most so many equal integers at a time
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + most, "right")))
            n = (hi - lo)[begin:end]
            if n.sum():
                rows = np.repeat(lo[begin:end] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                offset = np.repeat(at[begin:end], n) - where[rows]
                found.append(np.unique(owner[rows] * (2 * span) + offset + span, return_counts=True))
            begin = end
        if not found:
            continue
        keys, votes = found[0]
        if len(found) > 1:
            keys, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            votes = np.bincount(back, np.concatenate([v for _, v in found])).astype(np.int64)
        who, offset = keys // (2 * span), keys % (2 * span) - span
        need = np.minimum(least[who], _least(other, at, conf))
        enough = votes >= need
        who, offset, votes, need = (x[enough] for x in (who, offset, votes, need))
        done = -1
        for k in np.lexsort((offset, -votes, who)).tolist():
            if who[k] == done:
                continue
            found_at = stretch(queries[who[k]], other, int(offset[k]), int(need[k]), conf)
            if found_at:
                done = who[k]
                yield int(who[k]), nr, int(offset[k]), int(votes[k]), *found_at


def _meet(conf: Conf):
    schema = pa.schema([("cid", pa.string()), ("other", pa.string()), ("offset", pa.int32()), ("votes", pa.int32()), ("errors", pa.float64()), ("overlap", pa.int32())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ints = lambda column: [np.frombuffer(x, "<u4") for x in column.to_pylist()]
        names, asked = left.column("cid").to_pylist(), right.column("asked_cid").to_pylist()
        rows = []
        for q, o, *rest in align(ints(right.column("asked_fp")), ints(left.column("fp")), conf):
            if asked[q] != names[o]:
                rows.append((asked[q], names[o], *rest))
        return pa.table([pa.array([r[k] for r in rows], schema.types[k]) for k in range(6)], schema=schema)

    return run


def matches(prints: DataFrame, ids: list[str], is_query: Column, conf: Conf = Conf(), every: bool = True) -> DataFrame:
    """(ids..., copies, match, offset, votes, bit_errors, overlap, n_matches[, matches]) for each query row of (ids..., fp).

    copies: rows whose fingerprint equals the query's, itself included. matches: every other fingerprint that
    agrees, n_matches of them, by votes, then fewer bit errors, each as (match, offset, votes, bit_errors,
    overlap, copies) with its own number of rows. match: the ids, smallest first, of one as a struct;
    ``offset`` is where its integer stands against the query's first. The columns before n_matches are those of
    the best one. No other recording agrees: nulls, and no matches. Null fingerprints match nothing, with 0 copies.
    Repeated rows are copies of each other; an empty table gives no rows. Recordings may have any length.

    ``every``: whether all matches come, in one value for each query, which must hold them; without it they are
    counted and the best one is found by partial aggregates, however many there are.
    """
    name = F.struct(*(F.col(c) for c in ids))
    known = prints.where("fp IS NOT NULL").withColumn("cid", F.md5("fp"))
    # partial aggregates: a recording that a third of the rows copy arrives as a row from each task
    entries = stored(known.groupBy("cid").agg(F.min(name).alias("least"), F.count("*").alias("copies"), F.max(is_query).alias("asked"), F.first("fp").alias("fp")), "fingerprints")
    total = entries.agg(F.coalesce(F.sum(F.octet_length("fp") / 4), F.lit(0)), F.coalesce(F.sum(F.when(F.col("asked"), F.octet_length("fp") / 4)), F.lit(0))).first()
    chunks, blocks = (max(1, int(-(-n // size))) for n, size in zip(total, (conf.chunk, conf.block), strict=True))
    deal = lambda n: F.pmod(F.xxhash64("cid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = entries.select("cid", "fp", deal(chunks).alias("chunk"), every(blocks).alias("block"))
    right = entries.where("asked").select(F.col("cid").alias("asked_cid"), F.col("fp").alias("asked_fp"), deal(blocks).alias("block"), every(chunks).alias("chunk"))
    met = left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInArrow(
        _meet(conf), "cid string, other string, offset int, votes int, errors double, overlap int"
    )
    named = entries.select(F.col("cid").alias("other"), F.col("least").alias("match"), "copies")
    found = met.join(named, "other")
    # sorts by votes, most first, then errors, then fingerprint
    each = F.struct((-F.col("votes")).alias("rank"), F.col("errors").alias("bit_errors"), "other", "match", "offset", "votes", "overlap", "copies")
    fields = ("match", "offset", "votes", "bit_errors", "overlap", "copies")
    links = found.groupBy("cid").agg(F.min(each).alias("best"), F.count("*").alias("n_matches"), *([F.collect_list(each).alias("matches")] if every else []))
    asked = prints.where(is_query).select(*ids, F.md5("fp").alias("cid"))
    got = asked.join(entries.where("asked").select("cid", "copies"), "cid", "left").join(links, "cid", "left")
    all_of = F.transform(F.array_sort(F.coalesce("matches", F.array().cast(links.schema["matches"].dataType))), lambda x: F.struct(*(x[f].alias(f) for f in fields))) if every else None
    return got.select(
        *ids,
        F.coalesce("copies", F.lit(0)).cast("long").alias("copies"),
        *(F.col(f"best.{f}").alias(f) for f in fields[:-1]),
        F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"),
        *([all_of.alias("matches")] if every else []),
    )


# --- stand-in media ---------------------------------------------------------------------------------

RATE, NOTE = 4000, 256


def _notes() -> np.ndarray:
    """Samples of each pair of 24 pitches, from C4 up, softly begun and ended."""
    t = np.arange(NOTE) / RATE
    hz = 261.63 * 2 ** (np.arange(24) / 12)
    tones = np.sin(2 * np.pi * hz[:, None] * t) * np.minimum(1, np.minimum(np.arange(NOTE), np.arange(NOTE)[::-1]) / 16)
    return np.round(128 + 60 * tones[:, None] + 50 * tones[None]).clip(0, 255).astype(np.uint8).reshape(-1, NOTE)


def sonified(rows: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """(ids..., audio): a stand-in where no recordings are given. Each word of the whole text sounds as a pair of
    tones, so equal passages sound alike; null texts have null audio, texts without words no samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notes = _notes()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # audio is much larger than its text
                batch, out = whole.slice(at, 256), []
                for value in batch.column("text"):
                    t = value.as_py()
                    codes = [zlib.crc32(w) % 576 for w in t.lower().encode("utf-8", "surrogatepass").split()] if t is not None else None
                    out.append(None if codes is None else wav(notes[codes].ravel() if codes else np.empty(0, np.uint8), RATE))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ids), pa.array(out, pa.binary())], names=[*ids, "audio"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ids)
    return rows.select(*(f"`{c}`" for c in ids), F.col(text).cast("string").alias("text")).mapInArrow(run, f"{schema}, audio binary")
