import random
import re

import numpy as np
import xxhash
from cases import awkward, documents
from oracle import SF

from pagemill.llm import graph, queries, simhash


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows, bits=4):
    prints = sorted({p for _, p in rows})
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    least = {}
    for d, p in rows:
        if d is not None:
            least[find(p)] = min(d, least.get(find(p), d))
    return sorted(((d, f"{p:016x}", least.get(find(p))) for d, p in rows), key=repr)


def found(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=repr)


def test_fingerprint():
    r = random.Random(1)
    for text in [None, "", "  ", "a", "A b", "a b c", "a b c d", "É A\x0bb\x1cc d e f", *(t for _, t, *_ in awkward())]:
        assert simhash.fingerprint(text) == slow_print(text)
    for _ in range(50):
        text = " ".join(r.choice("ab cD ef É g".split()) for _ in range(r.randrange(20)))
        assert simhash.fingerprint(text) == slow_print(text)


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, slow_print(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(queries.op9_simhash(spark, SF)) == slow_components(rows)


def test_links_against_brute_force(spark):
    """Random prints, near ones at every distance, a chain and a dense group."""
    r = random.Random(6)
    prints = {r.getrandbits(64) for _ in range(300)}
    for p in list(prints)[:120]:
        q = p
        for b in r.sample(range(64), r.randrange(1, 7)):
            q ^= 1 << b
        prints.add(q)
    base = r.getrandbits(64)
    prints |= {base ^ (1 << a) ^ (1 << b) for a in range(16) for b in range(16)}
    chain = r.getrandbits(64)
    for k in range(16):
        chain ^= 0b111 << (4 * k)
        prints.add(chain)
    rows = list(enumerate(sorted(prints)))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    for partitions in (1, 5):
        df = spark.createDataFrame(signed, "fp long").repartition(partitions)
        roots = {r.node: r.root for r in graph.components(simhash.close_links(df)).collect()}
        groups = {}
        for d, p in rows:
            s = p - (1 << 64) if p >> 63 else p
            groups.setdefault(roots.get(s, s), []).append(d)
        assert sorted(((d, f"{p:016x}", min(groups[roots.get(s, s)])) for d, p in rows for s in [p - (1 << 64) if p >> 63 else p]), key=repr) == slow_components(rows)


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(-5, 200), (200, -5), (300, 300)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 160)} | {-5: -5, 200: -5}


def test_awkward(spark):
    rows = awkward()
    got = found(simhash.near_duplicates(documents(spark, rows)))
    assert got == slow_components([(d, slow_print(t)) for d, t, *_ in rows])
    by = {d: c for d, _, c in got}
    assert by[2] == by[3] == by[4] == 2 and by[None] is None and by[7] == 7
    docs = documents(spark, rows)
    kept = simhash.representatives(docs)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 5, 7, 8, 9, 10]
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.representatives(documents(spark, [])).count() == 0


def test_a_long_list_of_unlike_fingerprints():
    """All share three bytes; most have no link, some are near copies of others."""
    import time

    import numpy as np

    r = np.random.default_rng(8)
    prints = r.integers(0, 1 << 40, 100_000).astype(np.uint64) << np.uint64(24) | np.uint64(0x0A0B0C)
    for k in range(300):
        flips = sum(1 << int(b) for b in r.choice(np.arange(24, 64), int(r.integers(1, 6)), replace=False))
        prints[50_000 + k] = prints[k] ^ np.uint64(flips)
    prints = np.unique(prints)
    began = time.process_time()
    links = simhash._forest(simhash._octets(prints), simhash._close(4), 4, (0, 1, 2))
    assert time.process_time() - began < 60
    got = {tuple(sorted((int(prints[a]), int(prints[b])))) for a, b in links}
    want = set()
    for k in r.choice(len(prints), 400, replace=False).tolist() + list(range(0, len(prints), 500)):
        near = np.flatnonzero(np.bitwise_count(prints ^ prints[k]) <= 4)
        want |= {tuple(sorted((int(prints[k]), int(prints[x])))) for x in near if x != k}
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in got:
        root[find(a)] = find(b)
    assert all(find(a) == find(b) for a, b in want) and all((a ^ b).bit_count() <= 4 for a, b in got)
    assert 500 < len(got) < 1000  # over 200 planted, and about 460 by chance


def slow_groups(texts, similarity=0.8):
    """Groups of places of texts by brute force over sets of five-word shingles, word by word."""
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for k, s in enumerate(sets):
        if not s:
            by.setdefault((), []).append(k)
        for x in s:
            by.setdefault(x, []).append(k)
    for k, s in enumerate(sets):
        shared = {}
        for x in s or [()]:
            for j in by[x]:
                shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if j < k and (not s or n / (len(s) + len(sets[j]) - n) >= similarity):
                root[find(j)] = find(k)
    return [find(k) for k in range(len(sets))]


def slow_distinct(rows):
    """(doc_id, text) that stay: by group the smallest id, null last; texts tell rows apart that share it."""
    groups = {}
    for (d, t, *_), g in zip(rows, slow_groups([t for _, t, *_ in rows]), strict=True):
        groups.setdefault(g, []).append((d is None, d))
    return sorted((min(x) for x in groups.values()), key=repr)


def stays(df):
    return sorted(((r.doc_id is None, r.doc_id) for r in df.collect()), key=repr)


def test_distinct_documents_against_brute_force(spark):
    for sf in (SF, "/root/testdata/sf0.001"):
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert stays(simhash.distinct_documents(docs)) == slow_distinct(rows)
        assert len(slow_distinct(rows)) < len({t for _, t in rows})


def edited(r, words, n):
    words = list(words)
    for k in r.sample(range(len(words)), n):
        words[k] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def test_a_large_group_of_near_copies(spark):
    """Copies of a few texts that share most of each other, at similarities around the threshold; lists are long, so rounds are needed."""
    r = random.Random(12)
    first = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = [(1000 + k, edited(r, first, r.randrange(1, 4))) for k in range(250)]
    second = edited(r, first, 6).split()  # below the threshold of the first text itself
    rows += [(2000 + k, edited(r, second, r.randrange(0, 4))) for k in range(60)]
    rows += [(3000 + k, edited(r, first, r.randrange(5, 9))) for k in range(60)]
    rows += [(k, " ".join(f"own{k}x{j}" for j in range(40))) for k in range(30)]
    r.shuffle(rows)
    docs = documents(spark, [(d, t, "en", "a") for d, t in rows])
    want = slow_distinct(rows)
    assert 30 < len(want) < 250
    for small in (4, 64):
        assert stays(simhash.distinct_documents(docs, simhash.Near(small=small))) == want


def test_pairs_of_every_similarity(spark):
    """Recall over planted pairs from just above the threshold on, and none below it."""
    r = random.Random(13)
    rows, k = [], 0
    for n in (8, 20, 60, 200, 1000):
        for _ in range(60):
            words = [f"w{r.randrange(10**6)}" for _ in range(n)]
            rows += [(k, " ".join(words)), (k + 1, edited(r, words, r.randrange(0, 1 + max(1, n // 30))))]
            k += 2
    groups = slow_groups([t for _, t in rows])
    pairs = {a for a in range(0, k, 2) if groups[a] == groups[a + 1]}
    left = {d for _, d in stays(simhash.distinct_documents(documents(spark, [(d, t, "en", "a") for d, t in rows])))}
    assert len(pairs) > 150 and all(a in left for a in range(0, k, 2)) and all(a + 1 in left for a in range(0, k, 2) if a not in pairs)
    assert sum(a + 1 not in left for a in pairs) >= 0.99 * len(pairs)


def test_positional_bytes_of_long_texts():
    many = np.random.default_rng(3).integers(0, 1 << 63, (1 << 20) + 5).astype(np.uint64)
    got = simhash.positional_bytes(many, 40)
    turn = simhash._mix(np.array([40], np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    assert got[39] == simhash._mix(np.array([simhash._mix(many ^ turn).min()]))[0] & np.uint64(255)
    assert len(simhash.shingles("a b c")) == 1 and len(simhash.shingles(" ")) == 0 and len(simhash.shingles("a b c d e a b c d e f")) == 6


def test_distinct_awkward(spark):
    rows = awkward()
    docs = documents(spark, rows)
    kept = simhash.distinct_documents(docs)
    assert kept.schema == docs.schema and stays(kept) == slow_distinct(rows)
    # rows that share an id stay apart where their texts differ; rows without an id are documents too
    rows = [(7, "one two three four five six seven", "en", "a"), (7, "ONE two three four five six  seven", "en", "b"), (7, "quite another text stands here under it", "en", "a")]
    rows += [(None, "no id one of its own kind here", "en", "a"), (None, "no id one of its own kind here", "en", "a"), (None, "", "en", "a"), (9, None, "en", "a"), (8, "quite another text stands here under it", "en", "a")]
    got = simhash.distinct_documents(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), (r.text or "").lower().split()[:2]) for r in got) == [("7", ["one", "two"]), ("7", ["quite", "another"]), ("9", []), ("None", ["no", "id"])]
    assert simhash.distinct_documents(documents(spark, [])).count() == 0
    assert simhash.distinct_documents(documents(spark, [(1, None, None, None), (2, " ", None, None)])).count() == 1


def test_representatives_of_rows_that_share_an_id(spark):
    same = "the same words stand here in this row for all of them"
    rows = [(7, same, "en", "a"), (7, same, "en", "b"), (7, "something else altogether is written in this one", "en", "a"), (9, same, "en", "a"), (None, same, "en", "a"), (None, "only without an id", "en", "a")]
    for partitions in (1, 4):
        got = simhash.representatives(documents(spark, rows, partitions)).collect()
        assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("7", same), ("7", rows[2][1]), ("None", "only without an id")])
