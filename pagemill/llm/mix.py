"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

A source's documents are dealt to shards by hash and laid end to end there in a seeded random order; the
words of a shard are cut into blocks of equal size. Whole passes that a target asks for are taken as they
are. For the rest, the blocks of all sources are seats: they go to sources by highest quotients, then within
a source to groups of shards and within a group to its shards, which gives an integer quota for each shard. A
shard takes its quota as a run of blocks from a seeded start, around its end. As its documents lie in random
order, a run is a random sample of them that cuts two documents at most.

Shards hold a bounded number of words, so the one source that has a third of all rows has many shards, and so
do rows that are alike in everything: their copies are dealt out in turn. A group has a bounded number of
shards. What reaches the driver is a row for each source and for each group of shards.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.shared import discard, row_columns, stored, whole_row

#: A word is a run of other characters than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_SOURCES = 100_000


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (3, 1, 2)  # by order of the source's code points, null last, repeating
    share: float = 1.5  # of all words
    most: float = 2.0  # times its size that a source, and so a document, is taken at most
    block_words: int = 32
    shard_words: int = 1 << 20
    group_shards: int = 4096
    seed: int = 17


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sainte_lague(votes, seats: int, caps) -> np.ndarray:
    """Seats by highest quotients votes / (1, 3, 5, ...), at most ``caps`` each; ties go to the earlier one."""
    votes, caps = np.asarray(votes, float), np.asarray(caps, np.int64)
    caps = np.where(votes > 0, caps, 0)
    if seats >= caps.sum():
        return caps

    def above(t: float) -> np.ndarray:  # seats whose quotient is above t, less a rounding error
        return np.minimum(caps, np.maximum(0, np.floor((votes / t * (1 - 1e-12) + 1) / 2)).astype(np.int64))

    low, high = 0.0, 2 * votes.max()  # at high, nobody has a seat
    for _ in range(200):
        t = (low + high) / 2
        if t in (low, high):
            break
        low, high = (low, t) if above(t).sum() <= seats else (t, high)
    got = above(high * (1 + 1e-9))  # equal quotients near the edge are left to the queue, which knows their order
    queue = [(-votes[k] / (2 * got[k] + 1), k) for k in range(len(votes)) if got[k] < caps[k]]
    heapq.heapify(queue)
    for _ in range(seats - int(got.sum())):
        _, k = heapq.heappop(queue)
        got[k] += 1
        if got[k] < caps[k]:
            heapq.heappush(queue, (-votes[k] / (2 * got[k] + 1), k))
    return got


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Words by weight; what a source can't give at ``most`` times its size is shared out again by weight."""
    full: set[int] = set()
    while True:
        open_ = [k for k in range(len(sizes)) if k not in full]
        if not open_:
            return [most * s for s in sizes]
        level = (total - sum(most * sizes[k] for k in full)) / sum(weights[k] for k in open_)
        over = {k for k in open_ if weights[k] * level > most * sizes[k]}
        if not over:
            return [most * sizes[k] if k in full else weights[k] * level for k in range(len(sizes))]
        full |= over


def _seeded(seed: int, *values: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(v.cast("string"), F.lit("null")) for v in values)).cast("binary"))


def _number(md5: Column) -> Column:
    return F.conv(F.substring(md5, 1, 8), 16, 10).cast("long")


def _dealt(rows: DataFrame, conf: Mix) -> DataFrame:
    """``rows`` (at, nr, shards, key, size, tie) with a shard each.

    Rows that are alike in key, size and tie, and hold a good part of a shard's words, are told apart by their
    places among themselves, which are found in many tasks; so they spread over all shards, as many to each in
    every run. Other rows go by hash.
    """
    alike = ["nr", "key", "size", "tie"]
    spot = F.pmod(F.xxhash64("key", "size", "tie"), F.col("shards"))
    many = rows.where("shards > 1").groupBy(*alike).agg(F.count("*").alias("copies")).where(F.col("copies") * F.col("size") > conf.shard_words // 8)
    many = stored(many, "repeats")
    if many.isEmpty():
        return rows.withColumn("shard", spot)
    # stored sides, so that Spark may split the rows of a group
    hot = stored(rows.join(many.drop("copies"), alike).withColumn("part", F.pmod(F.xxhash64("at"), F.lit(1009))), "repeated")
    before = Window.partitionBy(*alike).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = hot.groupBy(*alike, "part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy(*alike, "part").orderBy("at")) - 1
    numbered = hot.withColumn("inside", inside).join(counts, [*alike, "part"])
    turn = F.pmod(spot + F.col("before") + F.col("inside"), F.col("shards"))
    cold = rows.join(many.drop("copies"), alike, "left_anti").withColumn("shard", spot)
    return cold.unionByName(numbered.withColumn("shard", turn).select(*cold.columns))


def mixed(docs: DataFrame, size: Column, doc_id: Column, source: Column, conf: Mix = Mix(), tie: Column | None = None) -> DataFrame:
    """(row, size, source_size, target, passes, parts, taken) for each row; ``row`` is the row of ``docs``.

    passes: how often the whole document is taken; parts: array of word ranges [from, to) taken once more.
    Null ids and null sources are values of their own, null last; equal rows are documents of their own; no
    rows or no words give targets of 0. Columns of ``docs`` may have any names, they stay inside ``row``.
    ``tie`` orders rows that share id and size, as a hash of the text does. Sizes are found once; only narrow
    rows are laid out, and a document of any length is one of them.
    """
    spark = docs.sparkSession
    tie = F.lit(0).cast("long") if tie is None else tie.cast("long")
    given = docs.select(whole_row(docs).alias("row"), size.alias("size"), source.alias("source"), _seeded(conf.seed, doc_id).alias("key"), tie.alias("tie"))
    whole = stored(given.withColumn("at", F.monotonically_increasing_id()), "mix")
    rows = whole.drop("row")
    by = sorted(((r.source, r.n) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    sizes, b = [int(n) for _, n in by], conf.block_words
    weights = [conf.weights[k % len(conf.weights)] for k in range(len(by))]
    want = targets(sizes, weights, conf.share * sum(sizes), conf.most) if sum(sizes) else [0.0] * len(by)
    passes = [int(t // s) if s else 0 for t, s in zip(want, sizes, strict=True)]
    rest = [max(0.0, t - p * s) for t, p, s in zip(want, passes, sizes, strict=True)]
    shards = [max(1, -(-s // conf.shard_words)) for s in sizes]
    plan = spark.createDataFrame(
        [(k, s, n, float(t), p, m) for k, ((s, n), t, p, m) in enumerate(zip(by, want, passes, shards, strict=True))],
        "nr int, source string, source_size long, target double, passes int, shards long",
    )
    plan = F.broadcast(plan) if len(by) <= BROADCAST_SOURCES else plan
    dealt = stored(_dealt(rows.join(plan, rows.source.eqNullSafe(plan.source)).drop("source"), conf), "dealt")
    lengths = dealt.groupBy("nr", "shard").agg(F.sum("size").alias("length"))
    lengths = lengths.withColumn("blocks", F.ceil(F.col("length") / b).cast("long")).withColumn("group", F.expr(f"shard div {conf.group_shards}"))
    groups = sorted((r.nr, r["group"], int(r.length), int(r.blocks)) for r in lengths.groupBy("nr", "group").agg(F.sum("length").alias("length"), F.sum("blocks").alias("blocks")).collect())
    seats = spark.createDataFrame(_to_groups(groups, rest, b), "nr int, group long, quota long")
    given = lengths.join(seats, ["nr", "group"]).groupBy("nr", "group").applyInPandas(_to_shards, "nr int, shard long, length long, blocks long, quota long")
    start = F.when(F.col("blocks") > 0, F.pmod(_number(_seeded(conf.seed, F.col("nr"), F.col("shard"))), F.col("blocks"))).otherwise(0)
    given = given.select("nr", "shard", (start * b).alias("from"), ((start + F.col("quota")) * b).alias("to"), (F.col("blocks") * b).alias("around"))

    w = Window.partitionBy("nr", "shard").orderBy("key", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = dealt.withColumn("end", F.sum("size").over(w)).withColumn("begin", F.col("end") - F.col("size")).join(given, ["nr", "shard"])
    first = F.struct(F.greatest(F.col("from"), F.col("begin")).alias("a"), F.least(F.col("to"), F.col("end")).alias("b"))
    again = F.struct(F.greatest(F.lit(0), F.col("begin")).alias("a"), F.least(F.col("to") - F.col("around"), F.col("end")).alias("b"))
    parts = F.filter(F.array(again, first), lambda x: x["b"] > x["a"])
    parts = F.transform(parts, lambda x: F.struct((x["a"] - F.col("begin")).alias("a"), (x["b"] - F.col("begin")).alias("b")))
    taken = F.col("passes") * F.col("size") + F.aggregate("parts", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    found = laid.withColumn("parts", parts).select("at", "size", "source_size", "target", "passes", "parts", taken.cast("long").alias("taken"))
    found = stored(found, "plan")
    discard(dealt)
    return whole.select("at", "row").join(found, "at").drop("at")


def _to_groups(groups: list[tuple[int, int, int, int]], rest: list[float], block_words: int) -> list[tuple[int, int, int]]:
    """(source, group, quota) of sorted (source, group, length, blocks): seats go to sources first, then to their groups."""
    if not any(rest):
        return [(nr, group, 0) for nr, group, _, _ in groups]
    room = [0] * len(rest)
    for nr, _, _, blocks in groups:
        room[nr] += blocks
    quota = sainte_lague(rest, int(round(sum(rest) / block_words)), room)
    out = []
    for nr, some in groupby(groups, key=lambda x: x[0]):
        some = list(some)
        got = sainte_lague([x[2] for x in some], int(quota[nr]), [x[3] for x in some])
        out += [(nr, x[1], int(n)) for x, n in zip(some, got, strict=True)]
    return out


def _to_shards(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("shard", ignore_index=True)
    pdf["quota"] = sainte_lague(pdf["length"], int(pdf["quota"].iloc[0]), pdf["blocks"])
    return pdf[["nr", "shard", "length", "blocks", "quota"]]


def mixed_texts(docs: DataFrame, conf: Mix = Mix()) -> DataFrame:
    """The mix itself: each document's row as often as it is taken whole, and a row for each part taken, with its text cut to it.

    Columns are those of ``docs``; ``n_chars`` follows the text if it is there. Null and empty texts, and those
    without words, aren't taken. Repeated rows are documents of their own; an empty table gives no rows.
    """
    text = F.col("text")
    got = mixed(docs, words(text), F.col("doc_id"), F.col("source"), conf, F.xxhash64(text))
    whole = F.when(F.col("size") > 0, F.array_repeat(F.struct(F.lit(0).cast("long").alias("a"), F.col("size").alias("b")), F.col("passes"))).otherwise(F.array())
    each = got.select("row", "size", F.explode(F.concat(whole, "parts")).alias("part"))
    # words with the white space behind them; only evaluated for the few cut documents
    pieces = F.split(F.col("row.text"), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(F.col("row.text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)  # white space before the first word is a piece
    part = F.array_join(F.slice(pieces, (F.col("part.a") + lead + 1).cast("int"), (F.col("part.b") - F.col("part.a")).cast("int")), "")
    new = F.when((F.col("part.a") == 0) & (F.col("part.b") == F.col("size")), F.col("row.text")).otherwise(part)
    out = dict(zip(docs.columns, row_columns(docs), strict=True)) | {"text": new}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length(new).cast(docs.schema["n_chars"].dataType)
    return each.select(*(v.alias(c) for c, v in out.items()))
