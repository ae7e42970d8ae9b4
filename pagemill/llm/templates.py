"""Line dedup with a log-template tree: recurring templates across documents are dropped.

Each line walks a tree of fixed depth: its token count, its leading tokens, then four segments of the other
tokens. Tokens with a digit are variable fields from the start. Where the leading tokens agree, one segment
may vary as a whole: the line belongs to its exact path and to four paths with a wildcard in one segment,
and so shares a template with every line that has the same count, lead and three of the four segments. The
paths are keys, so templates are counted with partial aggregates, and neither a leaf with very many lines nor
a template in a third of all documents meets in one task.

A template recurs if it is in ``least_docs`` documents or more. The document with the smallest id among them
keeps its line, the others lose theirs; so what many documents share stays in the corpus once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.shared import discard, stored


@dataclass(frozen=True)
class Conf:
    lead: int = 2  # leading tokens that must agree
    segments: int = 4  # of the rest, one of which may vary
    least_general: int = 8  # tokens of a line from which a segment may vary
    least_tokens: int = 3  # shorter lines are never dropped
    least_docs: int = 3


_DIGIT = re.compile(rb"[0-9]")
_LAST = (1 << 63) - 1
_NAMES = ["doc", "text_key", "text_more", "text_no", "line_no", "key", "more", "fresh"]
_TYPES = [pa.int64()] * 4 + [pa.int32()] + [pa.int64()] * 2 + [pa.bool_()]
_ROWS = "doc long, text_key long, text_more long, text_no long, line_no int, key long, more long, fresh boolean"


def paths(line: bytes, conf: Conf = Conf()) -> list[bytes]:
    """The exact path first, then the generalised ones; none for a line that is too short to drop.

    Tokens lie between ASCII white space; one with a digit is a variable field.
    """
    tokens = line.split()
    n = len(tokens)
    if n < conf.least_tokens:
        return []
    if _DIGIT.search(line):
        tokens = [b"<*>" if _DIGIT.search(t) else t for t in tokens]
    top, rest = b"%d " % n + b" ".join(tokens[: conf.lead]), tokens[conf.lead :]
    if n < conf.least_general:
        return [top + b"\n" + b" ".join(rest)]
    m, k = len(rest), conf.segments
    parts = [b" ".join(rest[m * i // k : m * (i + 1) // k]) for i in range(k)]
    return [b"\n".join([top, *parts]), *(b"\n".join([top, *parts[:i], b"<*>", *parts[i + 1 :]]) for i in range(k))]


def _keyed(conf: Conf):
    import numpy as np
    import xxhash

    h = xxhash.xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            halves = np.frombuffer(b"".join(keys), ">i8").astype(np.int64)  # 128 bits: no two paths meet by chance
            whole = [docs, texts, mores, text_nos, numbers, halves[::2], halves[1::2], fresh]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(whole, _TYPES, strict=True)], names=_NAMES)
            for c in columns:
                c.clear()
            return out

        text_no = (TaskContext.get().partitionId() << 33) - 1
        columns = docs, texts, mores, text_nos, numbers, keys, fresh = [], [], [], [], [], [], []
        for given in batches:
            for doc, text_key, text_more, text in zip(*(given.column(c).to_pylist() for c in ("doc", "text_key", "text_more")), given.column("text"), strict=True):
                seen: set[bytes] = set()
                text_no += 1
                for nr, line in enumerate(text.as_py().encode("utf-8", "surrogatepass").split(b"\n")):
                    found = paths(line, conf)
                    for path in found[1:] or found:  # lines on one exact path share all its generalised ones
                        key = h(path)
                        docs.append(doc)
                        texts.append(text_key)
                        mores.append(text_more)
                        text_nos.append(text_no)
                        numbers.append(nr)
                        keys.append(key)
                        fresh.append(key not in seen)
                        seen.add(key)
                    if len(keys) > 100_000:  # within a text too, however many lines it has
                        yield batch()
        if keys:
            yield batch()

    return run


def _place(doc_id: Column) -> Column:
    """Where a document stands among others: by id, null last."""
    return F.coalesce(doc_id.cast("long"), F.lit(_LAST))


def _text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def recurring_lines(docs: DataFrame, conf: Conf = Conf()) -> DataFrame:
    """(text_key, text_more, hits): for each text the lines on recurring templates, each with a document that comes first there."""
    text = F.col("text").cast("string")
    key, more = _text_key(text)
    given = docs.where(text.isNotNull()).select(_place(F.col("doc_id")).alias("doc"), key.alias("text_key"), more.alias("text_more"), text.alias("text"))
    rows = stored(given.mapInArrow(_keyed(conf), _ROWS), "lines")
    # counted by partial aggregates, so a template in very many documents arrives as a row from each task
    often = rows.groupBy("key", "more").agg(F.count_if("fresh").alias("docs"), F.min("doc").alias("first")).where(F.col("docs") >= conf.least_docs)
    often = stored(often.select("key", "more", "first"), "templates")
    # an inner join of stored sides, so that Spark may split a template with very many lines; running numbers stand
    # for the texts, as they take less room in the shuffle than hashes
    hit = rows.select("text_no", "line_no", "key", "more").join(often, ["key", "more"])
    hits = hit.groupBy("text_no").agg(F.collect_set(F.struct("line_no", "first")).alias("hits"))
    names = rows.select("text_no", "text_key", "text_more").distinct()
    # copies of a text have the same hits
    hits = hits.join(names, "text_no").groupBy("text_key", "text_more").agg(F.first("hits").alias("hits"))
    # stored: a text with very many copies meets its hits in a join that Spark may split
    hits = stored(hits, "hits")
    discard(rows, often)
    return hits


def deduplicated(docs: DataFrame, conf: Conf = Conf()) -> DataFrame:
    """(row, text, n_lines, n_dropped) for each row: the text without dropped lines.

    Null texts stay null, with no lines; the empty text has one line, which is never dropped. Repeated rows, and
    rows that share an id, are counted apart but never drop each other's lines, as neither comes first. Rows
    without an id come last, all at one place. Columns of ``docs`` may have any names, they stay inside ``row``.
    An empty table gives no rows. Work grows with a text's length, however many lines it has.
    """
    key, more = _text_key(F.col("text").cast("string"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _place(F.col("doc_id")).alias("doc"), key.alias("text_key"), more.alias("text_more"))
    lost = F.array_distinct(F.transform(F.filter("hits", lambda x: x["first"] < F.col("doc")), lambda x: x["line_no"]))
    got = whole.join(recurring_lines(docs, conf), ["text_key", "text_more"], "left").withColumn("lost", F.coalesce(lost, F.array().cast("array<int>")))
    lines = F.split(F.col("row.text"), "\n", -1)
    # the lines are bound once, the numbers of kept ones come from a set difference: linear in the lines
    kept = F.transform(F.array(lines), lambda all_: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col("lost")), lambda k: F.get(all_, k)), "\n"))
    return got.select(
        "row",
        F.when(F.size("lost") == 0, F.col("row.text")).otherwise(F.get(kept, F.lit(0))).alias("text"),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.size("lost").cast("long").alias("n_dropped"),
    )


def cleaned(docs: DataFrame, conf: Conf = Conf()) -> DataFrame:
    """Rows of ``docs`` with the text that is left; those that lose all their lines go. ``n_chars`` follows the text.

    Null and empty texts stay as they are; the rest is as in ``deduplicated``.
    """
    got = deduplicated(docs, conf).where("n_dropped = 0 OR n_dropped < n_lines")
    out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return got.select(*(v.alias(c) for c, v in out.items()))
