import re

import pytest
from cases import awkward, documents
from oracle import SF, compare
from pyspark.sql import functions as F

from pagemill.llm import mix, queries


def brute_seats(votes, seats, caps):
    got = [0] * len(votes)
    for _ in range(seats):
        open_ = [k for k in range(len(votes)) if got[k] < caps[k] and votes[k] > 0]
        if not open_:
            break
        got[max(open_, key=lambda k: (votes[k] / (2 * got[k] + 1), -k))] += 1
    return got


def test_sainte_lague():
    import random

    r = random.Random(2)
    for _ in range(300):
        n = r.randrange(1, 7)
        votes = [r.choice((0, 1, 2, 3, 10, 55.5)) for _ in range(n)]
        caps = [r.randrange(0, 9) for _ in range(n)]
        seats = r.randrange(0, 25)
        assert mix.sainte_lague(votes, seats, caps).tolist() == brute_seats(votes, seats, caps), (votes, seats, caps)


def test_targets():
    assert mix.targets([100, 100], [3, 1], 300, 2) == [200, 100]
    got = mix.targets([10, 100, 100], [3, 1, 2], 315, 2)
    assert got[0] == 20 and abs(sum(got) - 315) < 1e-9 and got[2] <= 200
    assert mix.targets([0, 10], [3, 1], 15, 2) == [0, 15]


@pytest.mark.parametrize("shard_words", [1 << 20, 600])
def test_mix(spark, shard_words):
    rows = [(k, "w " * (k % 50 + 1), "en", "abc"[k % 3] if k % 7 else None) for k in range(400)] + awkward()
    docs = documents(spark, rows)
    conf = mix.Mix(shard_words=shard_words, block_words=8)
    got = mix.mixed(docs, mix.words(F.col("text")), F.col("doc_id"), F.col("source"), conf, F.xxhash64("text")).select("row.doc_id", "row.source", "size", "source_size", "target", "taken").collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, []).append(r)
    for some in by.values():
        assert sum(r["size"] for r in some) == some[0].source_size
        assert some[0].target <= 2 * some[0].source_size
        parts = max(1, some[0].source_size // shard_words)
        assert abs(sum(r.taken for r in some) - some[0].target) <= 4 + 8 * (parts + 2)
    total = sum(r["size"] for r in got)
    assert sum(some[0].target for some in by.values()) == pytest.approx(1.5 * total)


def test_texts_follow_the_plan(spark):
    docs = documents(spark, awkward() + [(100 + k, f" lead{k} a\tb\nc d {k} ", "en", "abc"[k % 3]) for k in range(60)])
    plan = mix.mixed(docs, mix.words(F.col("text")), F.col("doc_id"), F.col("source"), mix.Mix(block_words=2), F.xxhash64("text"))
    want = {}
    for r in plan.select("row.doc_id", "taken").collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    out = mix.mixed_texts(docs, mix.Mix(block_words=2))
    assert out.columns == docs.columns
    got = {}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(re.findall(mix.WORD, r.text or ""))
        assert r.text is None or r.text in texts[r.doc_id] and r.n_chars == len(r.text)
    assert {k: v for k, v in want.items() if v} == {k: v for k, v in got.items() if v}


def test_empty(spark):
    assert mix.mixed_texts(documents(spark, [])).count() == 0
    assert mix.mixed_texts(documents(spark, [(1, None, None, None), (2, " ", None, "a")])).count() == 0


def test_query(spark):
    assert compare(queries.op1_mix(spark, SF), queries.ORACLE_SQL["op1_mix"]) == 1000
    assert sorted(queries.op1_mix(spark, SF).collect()) == sorted(queries.op1_mix(spark, SF).collect())


def test_rows_without_id_and_copies_spread(spark):
    """Neither a shared id nor rows that are alike in everything crowd a shard, and reruns over other partitions agree."""
    conf = mix.Mix(shard_words=400, block_words=8, group_shards=5)
    only_null = [(None, f"text {k} " * (k % 5 + 1), "en", "a") for k in range(1500)]
    copies = [(7, "the same row " * 4, "en", "a")] * 1500
    for rows in (only_null, copies, only_null + copies + [(k, f"own {k}", "en", "b") for k in range(300)]):
        seen = []
        for partitions in (2, 7):
            docs = documents(spark, rows, partitions)
            got = mix.mixed(docs, mix.words(F.col("text")), F.col("doc_id"), F.col("source"), conf, F.xxhash64("text")).select("row.doc_id", "row.text", "row.source", "size", "taken", "target").collect()
            assert len(got) == len(rows)
            seen.append(sorted(got, key=repr))
            by = {}
            for r in got:
                assert 0 <= r.taken <= 2 * r["size"]
                by.setdefault(r.source, []).append(r)
            for some in by.values():
                words = sum(r["size"] for r in some)
                assert abs(sum(r.taken for r in some) - some[0].target) <= 8 * (words // 400 + 3)
        assert seen[0] == seen[1]
    for rows in (only_null, copies):
        docs = documents(spark, rows).select(F.monotonically_increasing_id().alias("at"), F.lit(0).alias("nr"), F.lit(30).cast("long").alias("shards"), mix._seeded(17, F.col("doc_id")).alias("key"), mix.words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
        load = [r.n for r in mix._dealt(docs, conf).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
        assert len(load) == 30 and max(load) < 2 * sum(load) / 30


def test_quotas_of_groups():
    groups = [(0, 0, 50, 7), (0, 1, 30, 4), (2, 0, 10, 2)]
    got = mix._to_groups(groups, [40.0, 0.0, 16.0], 8)
    assert sum(n for _, _, n in got) == 7 and [x[:2] for x in got] == [(0, 0), (0, 1), (2, 0)]
    assert got[0][2] + got[1][2] == 5 and got[0][2] == brute_seats([50, 30], 5, [7, 4])[0] and got[2][2] == 2
    assert mix._to_groups(groups, [0.0, 0.0, 0.0], 8) == [(0, 0, 0), (0, 1, 0), (2, 0, 0)]
