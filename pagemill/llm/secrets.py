"""Secret scans: fixed patterns, and strings that a primed compressor finds new.

The patterns give three kinds of spans. The method adds a fourth: a string near a sensitive word is compressed
behind the text around it, with a zstandard dictionary of identifiers and words. Names, paths, prose and
whatever the surroundings already hold cost a few bytes; a random key costs nearly its own length. Strings
whose marginal cost is high for their length are reported; nothing but these costs decides.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns of the three base kinds, in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "novel")

# Words that make their surroundings sensitive.
SENSITIVE = re.compile(
    r"passw(?:or)?d|passphrase|secret|token|api[_-]?key|apikey|credential|private[_-]?key|access[_-]?key|auth(?:orization|_|\b)|bearer|signature|session[_-]?id|client[_-]?id|encryption|AKIA",
    re.IGNORECASE | re.ASCII,
)
FREQUENT_WORDS = 9_300
# stands before all surroundings: behind a few bytes a compressor stores anything as it is
_LEAD = "It was a quiet morning in the valley, and most of the people who lived there had already gone down to the river to look at the boats that came in during the night. "
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
_LONG = re.compile(r"[0-9a-f]{24,}")


@dataclass(frozen=True)
class Conf:
    before: int = 64  # characters between a sensitive word and what it makes suspicious, on either side
    around: int = 512  # characters of surrounding text on each side
    # marginal bytes for each byte of the candidate behind a quick parse, one with all words, and one with frequent words
    least_shares: tuple[float, float, float] = (0.3, 0.6, 0.64)
    least_bits: float = 56.0  # that a candidate's length and kinds of characters can carry; a card number can't


def _words() -> list[bytes]:
    """Words of a public vocabulary, by rank: the frequent ones first."""
    import base64

    import public_tokenizers

    rows = (x.split() for x in open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))
    words = (base64.b64decode(w).strip() for w, _ in sorted(rows, key=lambda x: int(x[1])))
    return [w for w in words if w.isalpha()]


@cache
def _compressor():
    """Zstandard with a dictionary of identifiers: the longer words of a public vocabulary and usual names in code."""
    import zstandard

    # Names that code uses around keys without being keys.
    names = b"password secret token api_key access_key private_key client_secret authorization bearer credentials config environment getenv os.environ process.env settings.py application.properties example placeholder changeme undefined null true false return import function class public static String const default username localhost https://www.example.com/path/to/resource "
    words = b" ".join(w for w in sorted(_words(), key=len) if len(w) >= 7)[-100_000:]
    data = zstandard.ZstdCompressionDict(words + b" " + names, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=9)
    return zstandard.ZstdCompressor(dict_data=data, write_checksum=False, write_content_size=False)


def _careful(words: bytes, strategy: int, search: int):
    import zstandard

    data = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(
        window_log=20, hash_log=17, chain_log=17, search_log=search, min_match=3, target_length=64, strategy=strategy, write_checksum=False, write_content_size=False
    )
    data.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=how)


@cache
def _thorough():
    """Zstandard with an optimal parse, short matches and all words of the vocabulary, which codes most plain words in a few bytes."""
    import zstandard

    return _careful(b" ".join(sorted((w for w in _words() if len(w) >= 4), key=len)), zstandard.STRATEGY_BTULTRA, 6)


@cache
def _frequent():
    """The same over frequent words in small letters, nearest those that are most frequent, as near matches cost least."""
    import zstandard

    words = dict.fromkeys(w.lower() for w in _words()[:FREQUENT_WORDS] if len(w) >= 4)
    return _careful(b"".join(reversed(words)), zstandard.STRATEGY_BTULTRA2, 8)


def novelty(candidate: str, around: str, compressor=_compressor) -> float:
    """Marginal compressed bytes for each byte of the candidate behind its surroundings."""
    c, lead, data = compressor(), around.encode("utf-8", "surrogatepass"), candidate.encode()
    return (len(c.compress(lead + b"\n" + data)) - len(c.compress(lead + b"\n"))) / max(1, len(data))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind): leftmost, not overlapping within a kind; matches that are too short take their place but don't count."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in _LONG.finditer(text)]  # whole runs, as runs of 24 or more are maximal
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _candidates(text: str, conf: Conf) -> Iterator[tuple[int, int]]:
    """(start, end) of strings that start shortly after a sensitive word or end shortly before one, by start.

    Strings are whole, wherever the limit falls. One that holds a sensitive word itself is followed by what
    stands before and after that word in it, which have the word next to them.
    """
    words = [(m.start(), m.end()) for m in SENSITIVE.finditer(text)]
    if not words:
        return
    starts, ends = [a for a, _ in words], [b for _, b in words]
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        k, n = bisect_right(ends, a), bisect_left(starts, b)  # words before k end by a; words from n on start at b or later
        if k and a - ends[k - 1] < conf.before or n < len(words) and starts[n] - b < conf.before:
            yield a, b
        inside = [(x, y) for x, y in words[k:n] if a <= x and y <= b]
        if inside:
            for x, y in ((a, inside[0][0]), (inside[0][1], b)):
                if part := _CANDIDATE.fullmatch(text, x, y):
                    yield part.span()


def bits(candidate: str) -> float:
    """How much a random string of that length over the same kinds of characters carries."""
    letters = [c for c in candidate if c.isalpha()]
    hexadecimal = all(c in "abcdef" for c in letters) or all(c in "ABCDEF" for c in letters)
    sizes = ((6 if hexadecimal else 26) if any(c.islower() for c in letters) else 0) + ((6 if hexadecimal else 26) if any(c.isupper() for c in letters) else 0)
    return len(candidate) * math.log2(max(2, sizes + 10 * any(c.isdigit() for c in candidate)))


def is_new(candidate: str, around: str, conf: Conf = Conf()) -> bool:
    """Whether every parse finds the candidate new behind its surroundings; the quick one comes first."""
    quick, thorough, frequent = conf.least_shares
    around = _LEAD + around
    return (
        bits(candidate) >= conf.least_bits
        and novelty(candidate, around) >= quick
        and novelty(candidate, around, _thorough) >= thorough
        and novelty(candidate.lower(), around, _frequent) >= frequent
    )


def novel_spans(text: str, base: list[tuple[int, int, str]], conf: Conf = Conf()) -> list[tuple[int, int, str]]:
    """Strings near a sensitive word on either side, new to the compressors and outside base spans (by start); they don't overlap.

    Keys don't excuse each other, nor their own copies: a string that is new behind surroundings without any other
    candidate doesn't count as surroundings of others.
    """
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, b, _ in base), max))
    asked, done = [], -1
    for a, b in _candidates(text, conf):
        before = bisect_left(starts, b)
        if a >= done and not (before and reach[before - 1] > a) and not SENSITIVE.fullmatch(text, a, b):
            asked.append((a, b))
            done = b

    def around(a: int, b: int, without: list[tuple[int, int]]) -> str:
        """The surroundings of [a, b) but for the spans ``without``, which come by place and don't overlap."""
        out, at, end = [], max(0, a - conf.around), b + conf.around
        for x, y in without[bisect_left(without, at, key=lambda s: s[1]) :]:
            if x >= end:
                break
            out.append(text[at : max(at, x)])
            at = max(at, y)
        out.append(text[at:end])
        return " ".join(out)

    first = [(a, b) for a, b in asked if is_new(text[a:b], around(a, b, asked), conf)]
    return [(a, b, "novel") for a, b in first if len(first) == len(asked) or is_new(text[a:b], around(a, b, first), conf)]


def scan(text: str | None, conf: Conf = Conf()) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) of a whole text, by start, then kind."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base, conf), key=lambda x: (x[0], KINDS.index(x[2])))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


_FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, secrets array<struct<kind:string,start:long,stop:long,text:string>>"


def find_secrets(docs: DataFrame, conf: Conf = Conf()) -> DataFrame:
    """A row for each document: counts and digest of base spans, all spans, and the strings themselves.

    Places are code points, ends exclusive. A null text is an empty one; without spans the digest is that of
    the empty string. Whole texts are scanned, in time that grows with their length. Repeated rows, and rows
    without an id, are scanned alike; an empty table gives no rows; further columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("text", pa.string())])
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = value.as_py()
                base, every = scan(text, conf)
                count = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
                rows.append((*count, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), [{"kind": k, "start": a, "stop": b, "text": text[a:b]} for a, b, k in every]))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(found)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "secrets"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _FOUND)
