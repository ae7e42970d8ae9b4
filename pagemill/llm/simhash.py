"""SimHash near-duplicates by an inverted index of byte positions with count filtering.

Two 64-bit fingerprints that differ in at most ``bits`` (4) bits differ in at most 4 of their 8 bytes, so at
least 4 positional bytes match. A posting list for each single positional byte would hold 1/256 of all
fingerprints, and tallying it pair by pair is quadratic. So postings are keyed by three positional bytes at
once: of any 7 positions, a pair with 4 matches has at least 3 in common, so the 35 triples of 7 positions
meet every pair that reaches the guaranteed minimum. Inside a posting list the shared positional bytes of
pairs are tallied, those with fewer than 4 go, and the rest are verified bit by bit. No link is lost.

Equal fingerprints are one entry, so copies cost nothing more. Lists that hold a group of near copies are
searched breadth first: each found entry is compared with those not found yet, which gives a spanning
forest instead of all pairs; rows out are fewer than rows in. A long list whose entries don't link is split by
the other positions, one of which any close pair must share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.graph import components
from pagemill.llm.shared import discard, row_columns, stored, whole_row

BITS, SHINGLE, SEED = 4, 4, 42
_BITS_OF = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Unsigned 64 bits; 0 without words. A bit is set if it is set in more than half of the shingles' XXH64."""
    import xxhash

    words = text.encode("utf-8").lower().split() if text else []  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(width, len(words)) - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(whole[a:b], SEED) for a, b in zip(starts, stops, strict=True)], "<u8")
    octets = hashes.view(np.uint8).reshape(n, 8)
    out = 0
    for k in range(8):
        ones = np.bincount(octets[:, k], minlength=256) @ _BITS_OF
        out |= int(((2 * ones > n) << np.arange(8)).sum()) << (8 * k)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of whole texts; fp holds the 64 bits as a signed number."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _byte(k: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * k).bitwiseAND(255)


def _postings(prints: DataFrame) -> DataFrame:
    keys = []
    for nr, (a, b, c) in enumerate(combinations(range(7), 3)):
        key = F.shiftleft(_byte(a), 16).bitwiseOR(F.shiftleft(_byte(b), 8)).bitwiseOR(_byte(c))
        keys.append(key.bitwiseOR(F.lit(nr << 24).cast("long")))
    return prints.select("fp", F.explode(F.array(*keys)).alias("key"))


def _octets(prints: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), -1)


def _close(bits: int):
    """Which rows of positional bytes share at least 8 - bits of them with x and differ in at most ``bits`` bits."""

    def close(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        differ = x ^ rows
        out = (differ == 0).sum(axis=-1) >= 8 - bits
        out[out] = np.bitwise_count(differ[out]).sum(axis=-1) <= bits
        return out

    return close


#: A list of more rows is split when so many of them had no link to any other.
SPLIT_ROWS, SPLIT_MISSES = 1024, 16


def _forest(rows: np.ndarray, close: Callable, least: int, shared: tuple[int, ...] = ()) -> list[tuple[int, int]]:
    """Links of a spanning forest of a list's close pairs, found breadth first; perhaps some more.

    ``rows`` (n, positions) holds bytes, all rows the same ones at the positions ``shared``; close pairs share at
    least ``least`` positions. Of a long list whose rows don't link, so many other positions are taken that each
    close pair must share one of them, and the list is split by each of these in turn.
    """
    links: list[tuple[int, int]] = []
    others = [k for k in range(rows.shape[1]) if k not in shared]
    needed = least - len(shared)
    rest, queue, misses = np.arange(len(rows)), [], 0
    while len(rest) + len(queue) > 1 and len(rest):
        if needed > 0 and misses >= SPLIT_MISSES and len(rest) > SPLIT_ROWS:
            pool = np.concatenate([np.array(queue, np.int64), rest])
            for place in others[: len(others) - needed + 1]:
                order = pool[np.argsort(rows[pool, place], kind="stable")]
                for some in np.split(order, np.flatnonzero(np.diff(rows[order, place])) + 1):
                    if len(some) > 1:
                        links += [(int(some[a]), int(some[b])) for a, b in _forest(rows[some], close, least, (*shared, place))]
            return links
        if queue:
            x = queue.pop()
        else:
            x, rest = int(rest[0]), rest[1:]
        hit = close(rows[x], rows[rest])
        if hit.any():
            links += [(x, int(y)) for y in rest[hit]]
            queue += rest[hit].tolist()
            rest = rest[~hit]
        else:
            misses += 1
    return links


def _each_list(run_list: Callable[[int, pa.RecordBatch], Iterator[pa.RecordBatch]], run_short: Callable | None = None, small: int = 0):
    """Runs over rows sorted by ``key``, list by list: ``run_list`` gets whole lists of more than ``small`` rows, and
    ``run_short`` all shorter ones of a part at once, as (places where lists begin, their sizes, rows)."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []  # the list that may go on in the next batch
        for batch in chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                first, last = batch.column("key")[0].as_py(), batch.column("key")[-1].as_py()
                going_on = bool(held) and held[-1].column("key")[-1].as_py() == first == last
                held.append(batch)
                if going_on:
                    continue
            if not held:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column("key").to_numpy()
            whole = len(keys) if batch is None else int(np.searchsorted(keys, keys[-1]))
            held = table.slice(whole).combine_chunks().to_batches() if whole < len(keys) else []
            if whole:
                yield table.slice(0, whole).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in parts(batches):
            keys = table.column("key").to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.append(starts, len(keys)))
            if run_short is not None:
                yield from run_short(np.repeat(sizes, sizes), table)
            for at, n in zip(starts[sizes > max(1, small)].tolist(), sizes[sizes > max(1, small)].tolist(), strict=True):
                yield from run_list(int(keys[at]), table.slice(at, n))

    return run


def _links(bits: int, small: int = 8):
    """Links of whole lists (key, fp)."""
    close = _close(bits)

    def batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

    def fps(table: pa.Table) -> np.ndarray:
        return table.column("fp").to_numpy().view(np.uint64)

    def short(size_of: np.ndarray, table: pa.Table) -> Iterator[pa.RecordBatch]:
        some = (size_of > 1) & (size_of <= small)
        keys, prints = table.column("key").to_numpy()[some], fps(table)[some]
        for lag in range(1, small):  # all pairs of short lists, many lists at once
            same = np.flatnonzero(keys[lag:] == keys[:-lag]) if len(keys) > lag else []
            if not len(same):
                break
            x, y = prints[same], prints[same + lag]
            ok = close(_octets(x), _octets(y))
            yield batch(x[ok], y[ok])

    def long(key: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        prints = fps(table)
        triple = list(combinations(range(7), 3))[key >> 24]
        found = np.array(_forest(_octets(prints), close, 8 - bits, triple), np.int64).reshape(-1, 2)
        yield batch(prints[found[:, 0]], prints[found[:, 1]])

    return _each_list(long, short, small)


def close_links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(u, v) links between different fingerprints that connect all pairs of at most ``bits`` (1 to 4) differing bits."""
    if not 1 <= bits <= 4:
        raise ValueError("the index guarantees pairs of at most 4 differing bits")
    dealt = _postings(prints).repartition("key").sortWithinPartitions("key")
    return dealt.select("key", "fp").mapInArrow(_links(bits), "u long, v long")


def _rooted(prints: DataFrame, bits: int) -> DataFrame:
    """``prints`` (fp, ...) of different fingerprints with the root of each one's component."""
    roots = stored(components(close_links(prints.select("fp"), bits)), "roots")
    return prints.join(roots, prints.fp == roots.node, "left").drop("node").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row.

    fingerprint: 16 lower-case hex digits. component_id: the smallest doc_id that links reach, its own
    included; links hold between fingerprints of at most ``bits`` differing bits, equal ones included. Null
    and empty texts have fingerprint 0 and link like any other; of very long texts all shingles count. Null ids
    count for nothing: a group of such rows only has a null component. Repeated rows are rows of their own; an
    empty table gives no rows.
    """
    rows = stored(fingerprints(docs), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    rooted = _rooted(prints, bits)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(rooted.join(least, "root").select("fp", "component_id"), "named")  # stored: copies meet it in a join that Spark may split
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows of ``docs``, one of each component: that with the smallest doc_id, null last.

    Rows that share an id are told apart by a hash of their texts, the least of which stays if both are of one
    component; rows of different components stay. Of repeated rows one stays. Null and empty texts are of one
    component; an empty table gives no rows; columns stay as they are.
    """
    text = F.col("text").cast("string")
    given = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("text_key"))
    whole = stored(given.withColumn("at", F.monotonically_increasing_id()), "documents")
    rows = stored(fingerprints(whole.select(F.col("at").alias("doc_id"), "row.text")).withColumnRenamed("doc_id", "at"), "fingerprints")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key", "at")
    prints = stored(rows.join(whole.drop("row"), "at").groupBy("fp").agg(F.min(place).alias("first")), "prints")
    kept = _rooted(prints, bits).groupBy("root").agg(F.min("first").alias("first")).select("first.at")
    return whole.select("at", "row").join(stored(kept, "kept"), "at", "left_semi").select(*row_columns(docs))


# --- near copies of a given similarity -------------------------------------------------------------------


@dataclass(frozen=True)
class Near:
    """Texts whose sets of shingles are similar: a text's shingles are all runs of ``shingle`` words."""

    shingle: int = 5
    similarity: float = 0.8  # shared shingles by all shingles of both
    places: int = 40  # positional bytes; each equal with a chance of the similarity
    together: int = 4  # bytes that make a key
    least: int = 22  # equal bytes of a candidate pair; of 40, similar pairs have 32 on average and fewer once in 10,000
    strong: int = 34  # equal bytes of the pairs that link a long list at first
    small: int = 64  # lists up to this size give all their candidate pairs at once
    wide_places: int = 512  # positional bytes by which rows of long lists are compared further
    wide_least: int = 376  # of 512, similar pairs have 410 on average and fewer once in 10,000
    seed: int = 42


def shingles(text: str | None, conf: Near = Near()) -> np.ndarray:
    """Sorted different 64-bit hashes of a text's shingles, as for fingerprints; none without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    h = xxhash.xxh64_intdigest
    each = np.array([h(w, conf.seed) for w in words], np.uint64)
    n = max(1, len(words) - conf.shingle + 1) if words else 0
    out = np.zeros(n, np.uint64)
    for k in range(min(conf.shingle, len(words))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + each[k : k + n])
    return np.unique(out)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads each bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def positional_bytes(hashes: np.ndarray, places: int) -> np.ndarray:
    """Byte k comes from the shingle whose hash is least under the k-th mixing: texts agree in it if that is the same shingle."""
    out = np.empty(places, np.uint64)
    turns = _mix(np.arange(1, places + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    block = max(1, (1 << 20) // max(1, len(hashes)))
    for at in range(0, places, block):  # very long texts a few places at a time
        out[at : at + block] = _mix(hashes[None] ^ turns[at : at + block, None]).min(axis=1)
    return (_mix(out) & np.uint64(255)).astype(np.uint8)


def _signed(text: Column, conf: Near) -> Column:
    """(cid, bytes, keys): the text's words as 128 bits, its positional bytes and the keys of its lists; without words no bytes and keys."""
    from pyspark.sql.functions import arrow_udf

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import xxhash

        lists = conf.places // conf.together
        for batch in batches:
            cids, octets, keys = [], [], []
            for value in batch:
                value = value.as_py()
                cids.append(xxhash.xxh3_128_digest(b" ".join(value.encode("utf-8", "surrogatepass").lower().split()) if value else b""))
                hashes = shingles(value, conf)
                if not len(hashes):
                    octets.append(None)
                    keys.append(None)
                    continue
                found = positional_bytes(hashes, conf.places)
                parts = found[: lists * conf.together].reshape(lists, -1).astype(np.int64)
                key = np.arange(lists, dtype=np.int64)
                for k in range(conf.together):
                    key = key << 8 | parts[:, k]
                octets.append(found.tobytes())
                keys.append(key)
            yield pa.StructArray.from_arrays([pa.array(cids, pa.binary()), pa.array(octets, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["cid", "bytes", "keys"])

    return arrow_udf(run, "cid binary, bytes binary, keys array<long>")(text)


def _shares(least: int):
    def close(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return (x == rows).sum(axis=-1) >= least

    return close


def _octet_rows(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _met_first(equal: np.ndarray, table: np.ndarray | int, conf: Near) -> np.ndarray:
    """Whether the first list that a pair shares is that of ``table``, by its equal positions: it counts there only."""
    lists = conf.places // conf.together
    whole = equal[:, : lists * conf.together].reshape(len(equal), lists, conf.together).all(axis=2)
    return whole.argmax(axis=1) == table


_PAIRS = "u long, v long, key long, bytes binary"


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), none, pa.nulls(len(a), pa.binary())], names=["u", "v", "key", "bytes"])


def _first_pairs(conf: Near):
    """Candidate pairs of lists (key, nr, bytes): all of a short list, strong ones of a spanning forest of a long one,
    whose rows follow as (nr, null, key, bytes)."""

    def short(size_of: np.ndarray, table: pa.Table) -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero((size_of > 1) & (size_of <= conf.small))
        if not len(some):
            return
        part = table.take(pa.array(some)).combine_chunks()
        keys, nrs, octets = part.column("key").to_numpy(), part.column("nr").to_numpy(), _octet_rows(part.column("bytes"))
        for lag in range(1, conf.small):
            same = np.flatnonzero(keys[lag:] == keys[:-lag]) if len(keys) > lag else []
            if not len(same):
                break
            for at in range(0, len(same), 1 << 16):
                x = same[at : at + (1 << 16)]
                equal = octets[x] == octets[x + lag]
                ok = (equal.sum(axis=1) >= conf.least) & _met_first(equal, keys[x] >> 8 * conf.together, conf)
                yield _pair_batch(nrs[x[ok]], nrs[x[ok] + lag])

    def long(key: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        nrs, octets = table.column("nr").to_numpy(), _octet_rows(table.column("bytes"))
        first = (key >> 8 * conf.together) * conf.together
        found = np.array(_forest(octets, _shares(conf.strong), conf.strong, tuple(range(first, first + conf.together))), np.int64).reshape(-1, 2)
        yield _pair_batch(nrs[found[:, 0]], nrs[found[:, 1]])
        n = table.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(nrs), pa.nulls(n, pa.int64()), *(table.column(c).combine_chunks() for c in ("key", "bytes"))], names=["u", "v", "key", "bytes"])

    return _each_list(long, short, conf.small)


def _more_pairs(conf: Near, most: int):
    """Candidate pairs (u, v, more) of long lists (key, nr, root, bytes, wide) between rows of different roots: for each
    row the ``most`` with most equal wide bytes. ``more``: whether there are others."""

    def long(key: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        roots = table.column("root").to_numpy()
        names, counts = np.unique(roots, return_counts=True)
        if len(names) < 2:
            return
        nrs, octets, wide = table.column("nr").to_numpy(), _octet_rows(table.column("bytes")), _octet_rows(table.column("wide"))
        # any pair of different roots has a row outside the largest group
        for x in np.flatnonzero(roots != names[counts.argmax()]).tolist():
            near = np.flatnonzero(roots != roots[x])
            near = near[_met_first(octets[near] == octets[x], key >> 8 * conf.together, conf)]
            equal = (wide[near] == wide[x]).sum(axis=1)
            near, equal = near[equal >= conf.wide_least], equal[equal >= conf.wide_least]
            if not len(near):
                continue
            more = len(near) > most
            if more:
                near = near[np.lexsort((nrs[near], -equal))[:most]]
            a, b = np.full(len(near), nrs[x]), nrs[near]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(near), more))], names=["u", "v", "more"])

    return _each_list(long)


def _shingled(whole: DataFrame, found: DataFrame, conf: Near) -> tuple[DataFrame, DataFrame]:
    """(nr, of) of all texts in pairs or long lists, their shingles, and (nr, wide) of the latter. Texts are moved once."""
    from pyspark.sql.functions import arrow_udf

    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shingles(x.as_py(), conf).view(np.int64) for x in batch], pa.list_(pa.int64()))

    def wide(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if not x.is_valid else positional_bytes(x.values.to_numpy().view(np.uint64), conf.wide_places).tobytes() for x in batch], pa.binary())

    each = found.select(F.explode(F.array("u", "v")).alias("at"), F.col("v").isNull().alias("long")).where("at IS NOT NULL")
    # a number for each, so that few of them go to all tasks as they are
    needed = stored(each.select("at").distinct(), "needed")
    texts = whole.select("at", F.col("row.text").cast("string").alias("text")).join(needed, "at")
    of = stored(texts.select(F.col("at").alias("nr"), arrow_udf(sets, "array<long>")("text").alias("of")), "shingles")
    listed = each.where("long").select(F.col("at").alias("nr")).distinct()
    more = of.join(listed, "nr", "left_semi").select("nr", arrow_udf(wide, "binary")("of").alias("wide"))
    return of, stored(more, "wide")


def _similar(pairs: DataFrame, of: DataFrame, conf: Near) -> DataFrame:
    """The pairs (u, v) whose texts are as similar as is asked, by all their shingles."""
    pairs = stored(pairs.select("u", "v").distinct(), "pairs")
    both = pairs.join(of.select(F.col("nr").alias("u"), F.col("of").alias("a")), "u").join(of.select(F.col("nr").alias("v"), F.col("of").alias("b")), "v")
    both = both.select("u", "v", F.size("a").alias("a"), F.size("b").alias("b"), F.size(F.array_intersect("a", "b")).alias("shared"))
    links = stored(both.where(F.col("shared") / (F.col("a") + F.col("b") - F.col("shared")) >= conf.similarity).select("u", "v"), "similar")
    discard(pairs)
    return links


def distinct_documents(docs: DataFrame, conf: Near = Near()) -> DataFrame:
    """Rows of ``docs``, one of each group of near copies: that with the smallest doc_id, null last.

    Texts link where their sets of shingles (lower-cased ASCII words as in ``fingerprint``; the whole sequence
    where there are fewer words) are as similar as ``conf`` asks; groups are what links reach. Equal texts are
    one entry; null texts, empty ones and those without words are equal. So rows that share an id stay apart where
    their texts differ; of repeated rows, and of rows that share id and text, one stays. An empty table gives
    no rows; columns stay as they are, extra ones included. Whole texts count, however long.

    A 64-bit SimHash can't tell such pairs: at a similarity of 0.8 a byte of it is equal with a chance of 0.27,
    so no number of equal bytes is guaranteed. The bytes here come from samples of a single shingle each and are
    equal with a chance of the similarity. They are indexed by position, four at a time; equal bytes of pairs
    that meet are counted, and pairs that reach the minimum are verified by all shingles of both texts.

    A long list, as of a large group of near copies, gives a spanning forest of strong pairs first. Where verified
    links leave it in several groups, each row outside the largest is compared by many more bytes with rows of other
    groups, best ones first and ever more of them, until none is left that reaches the minimum: so of the pairs
    that meet none is lost but by the chance that ``Near`` states.
    """
    given = docs.select(whole_row(docs).alias("row"), _signed(F.col("text").cast("string"), conf).alias("s"), F.col("doc_id").cast("long").alias("id"))
    whole = stored(given.withColumn("at", F.monotonically_increasing_id()), "documents")
    # copies of a text arrive as a row from each task; the number of the first row stands for the text
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "at")
    classes = whole.groupBy("s.cid").agg(F.min(place).alias("first"), F.first("s.bytes").alias("bytes"), F.first("s.keys").alias("keys"))
    classes = stored(classes.withColumn("nr", F.col("first.at")), "texts")
    postings = classes.select(F.explode("keys").alias("key"), "nr", "bytes").repartition("key").sortWithinPartitions("key")
    found = stored(postings.mapInArrow(_first_pairs(conf), _PAIRS), "candidates")
    of, wide = _shingled(whole, found, conf)
    links = _similar(found.where("v IS NOT NULL"), of, conf)
    roots = stored(components(links), "roots")
    lists = stored(found.where("v IS NULL").select("key", F.col("u").alias("nr"), "bytes").join(wide, "nr"), "lists")
    most = 16
    while True:
        named = lists.join(roots.withColumnRenamed("node", "nr"), "nr", "left").select("key", "nr", F.coalesce("root", "nr").alias("root"), "bytes", "wide")
        dealt = named.repartition("key").sortWithinPartitions("key")
        more = stored(dealt.mapInArrow(_more_pairs(conf, most), "u long, v long, more boolean"), "candidates")
        if more.isEmpty():
            break
        new, last = _similar(more, of, conf), more.where("more").isEmpty()
        discard(more)
        if not new.isEmpty():
            links = links.unionByName(new)
            roots = stored(components(links), "roots")
        if last:
            break
        most *= 16
    rooted = classes.select("nr", "first").join(roots.withColumnRenamed("node", "nr"), "nr", "left")
    kept = rooted.groupBy(F.coalesce("root", "nr").alias("root")).agg(F.min("first").alias("first")).select("first.at")
    # what goes is less than what stays, and Spark may send it to all tasks
    gone = stored(whole.select("at").join(kept, "at", "left_anti"), "gone")
    discard(classes, found, of, wide, links, lists, roots)
    return whole.select("at", "row").join(gone, "at", "left_anti").select(*row_columns(docs))
