"""Queries of the operators, with production parameters over whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import ann, best_two_fit, chroma, langid, mix, secrets, simhash, templates, token_output, warc
from pagemill.llm.shared import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    docs = _table(spark, d, "documents").select("doc_id", "source", mix.words(text).alias("size"), F.xxhash64(text).alias("tie"))
    got = mix.mixed(docs, F.col("size"), F.col("doc_id"), F.col("source"), tie=F.col("tie"))
    return got.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


def op2_langid(spark: SparkSession, d: str) -> DataFrame:
    return langid.identify(_table(spark, d, "documents"))


def op3_best_two_fit(spark: SparkSession, d: str) -> DataFrame:
    return best_two_fit.packed(_table(spark, d, "documents"), literals=True)


def op4_chroma(spark: SparkSession, d: str) -> DataFrame:
    """The tables hold no audio: turns of conversations sound as tones. Queries: conversations whose id is divisible by 20."""
    media = chroma.sonified(_table(spark, d, "conversations"), ["conv_id", "turn"])
    prints = stored(chroma.fingerprints(media), "audio")
    got = chroma.matches(prints, ["conv_id", "turn"], F.coalesce(F.col("conv_id") % 20 == 0, F.lit(False)), every=False)
    match = {f"match_{c}": F.col(f"match.{c}") for c in ("conv_id", "turn")}
    return got.withColumns(match).drop("match")


def op5_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.round_trip(_table(spark, d, "pages"))


def op6_ann(spark: SparkSession, d: str) -> DataFrame:
    return ann.nearest(_table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_templates(spark: SparkSession, d: str) -> DataFrame:
    got = templates.deduplicated(_table(spark, d, "documents").select("doc_id", "text"))
    return got.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", "text")


def op8_secrets(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, d, "documents")).drop("secrets")


def op9_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, d, "documents"))


def op10_token_output(spark: SparkSession, d: str) -> DataFrame:
    return token_output.read_matrices(token_output.write_matrices(_table(spark, d, "documents"), literals=True))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_langid": op2_langid,
    "op3_best_two_fit": op3_best_two_fit,
    "op4_chroma": op4_chroma,
    "op5_warc": op5_warc,
    "op6_ann": op6_ann,
    "op7_templates": op7_templates,
    "op8_secrets": op8_secrets,
    "op9_simhash": op9_simhash,
    "op10_token_output": op10_token_output,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mix": """
WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size FROM docs GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nr FROM s),
w AS (SELECT *, CASE nr % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w, 1.5::DOUBLE * sum(size) OVER () AS total FROM n),
o AS (SELECT *, coalesce(sum(2.0::DOUBLE * size) OVER (ORDER BY size / w, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before,
        sum(w) OVER (ORDER BY size / w, nr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight FROM w),
f AS (SELECT *, w * ((total - before) / weight) > 2.0 * size AS filled FROM o),
l AS (SELECT (max(total) - coalesce(sum(2.0::DOUBLE * size) FILTER (filled), 0.0)) / sum(w) FILTER (NOT filled) AS level FROM f),
t AS (SELECT source, nr, size, CASE WHEN filled THEN 2.0::DOUBLE * size ELSE w * level END AS target FROM f, l),
p AS (SELECT *, CASE WHEN size > 0 THEN floor(target / size) ELSE 0 END::BIGINT AS passes FROM t),
r AS (SELECT *, target - passes * size AS rest, (size + 31) // 32 AS blocks FROM p),
q AS (SELECT nr, rest / (2 * k + 1) AS quotient FROM (SELECT nr, rest, unnest(range(blocks)) AS k FROM r WHERE rest > 0)),
h AS (SELECT nr, row_number() OVER (ORDER BY quotient DESC, nr) AS place FROM q),
g AS (SELECT nr, count(*) AS quota FROM h WHERE place <= (SELECT round(sum(rest) / 32) FROM r) GROUP BY nr),
c AS (SELECT r.*, coalesce(quota, 0) AS quota, CASE WHEN blocks > 0 THEN ('0x' || substr(md5('17:' || nr || ':0'), 1, 8))::BIGINT % blocks ELSE 0 END AS start FROM r LEFT JOIN g USING (nr)),
x AS (SELECT d.doc_id, d.size, c.size AS source_size, target, passes, start * 32 AS a, (start + quota) * 32 AS b, (start + quota - blocks) * 32 AS again,
        sum(d.size) OVER (PARTITION BY nr ORDER BY md5('17:' || coalesce(d.doc_id::VARCHAR, 'null')), d.size ROWS UNBOUNDED PRECEDING) AS e
      FROM docs d JOIN c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target,
  (passes * size + greatest(0, least(b, e) - greatest(a, e - size)) + greatest(0, least(again, e) - (e - size)))::BIGINT AS taken FROM x
""",
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, row_number() OVER (ORDER BY page_id NULLS FIRST) AS uid FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(encode(html)) AS h,
        row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, uid DESC) AS place,
        first_value(page_id) OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, uid DESC) AS top FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h || '0', 5 * i // 4 + 1, 2))::INTEGER >> (3 - 5 * i % 4)) & 31) + 1)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN top END AS refers_to FROM d
""",
    "op7_templates": r"""
WITH d AS (SELECT row_number() OVER () AS nr, coalesce(doc_id, 9223372036854775807) AS place, doc_id, text FROM documents),
l AS (SELECT nr, place, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM d WHERE text IS NOT NULL),
t AS (SELECT *, list_transform(list_filter(string_split_regex(line, '[\t\n\x0b\f\r ]+'), lambda x: x <> ''),
        lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM l),
s AS (SELECT *, len(w) || ' ' || array_to_string(w[1:2], ' ') AS top, w[3:] AS rest, len(w) - 2 AS m FROM t WHERE len(w) >= 3),
p AS (SELECT *, [array_to_string(rest[m * i // 4 + 1 : m * (i + 1) // 4], ' ') for i in range(4)] AS part FROM s),
k AS (SELECT nr, place, line_no, unnest(CASE WHEN len(w) < 8 THEN [top || chr(10) || array_to_string(rest, ' ')]
        ELSE list_transform(range(5), lambda g: top || chr(10) || array_to_string([CASE WHEN i + 1 = g THEN '<*>' ELSE part[i + 1] END for i in range(4)], chr(10))) END) AS key FROM p),
often AS (SELECT key, min(place) AS first FROM k GROUP BY key HAVING count(DISTINCT nr) >= 3),
lost AS (SELECT DISTINCT nr, line_no FROM k JOIN often USING (key) WHERE place <> first),
kept AS (SELECT l.nr, count(*) AS n_lines, count(lost.nr) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY l.line_no) FILTER (lost.nr IS NULL), '') AS text
         FROM l LEFT JOIN lost ON lost.nr = l.nr AND lost.line_no = l.line_no GROUP BY l.nr)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, kept.text FROM d LEFT JOIN kept USING (nr)
""",
}
