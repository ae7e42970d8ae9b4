import numpy as np
from oracle import SF
from pyspark.sql import functions as F

from pagemill.llm import ann, queries

SCHEMA = "vec_id long, embedding array<float>, cid string, leaf int, ids string"


def vectors(spark, rows, partitions=3):
    return spark.createDataFrame([(k, v, "c", 1, "i") for k, v in rows], SCHEMA).repartition(partitions)


def brute(rows, is_query, k=10):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if is_query(i):
            near = sorted({(float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in good if j != i})[:k]
            out[i] = near
    return out


def by_query(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    return {q: [(s, v) for _, s, v in sorted(x)] for q, x in got.items()}


def test_recall(spark):
    for sf in (SF, "/root/testdata/sf0.1"):
        rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
        want, got = brute(rows, lambda i: i % 100 == 0), by_query(queries.op6_ann(spark, sf))
        assert got.keys() == want.keys()
        hits = sum(len({v for _, v in got[q]} & {v for _, v in want[q]}) for q in want)
        assert hits >= 0.9 * sum(map(len, want.values()))
        dist = {(q, v): s for q in want for s, v in want[q]}
        for q, near in got.items():
            assert len(near) == 10 and near == sorted(near) and all(abs(dist.get((q, v), s) - s) < 1e-12 for s, v in near)


def test_awkward_vectors(spark):
    r = np.random.default_rng(2)
    rows = [(k, r.normal(size=4).astype(np.float32).tolist()) for k in range(40)]
    rows += [(100 + k, [1.0, 0.0, -0.0, 2.0]) for k in range(30)] + [(200, [1.0, 0.0, 0.0, 2.0]), (200, [1.0, 0.0, 0.0, 2.0])]
    rows += [(1000, None), (1100, []), (1200, [0.0] * 4), (1300, [1.0, None, 0.0, 0.0]), (1400, [float("nan"), 1.0, 1.0, 1.0]), (1500, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (1600, [1.0, 2.0])]
    # all leaves are visited, so results are exact
    conf = ann.Conf(leaf_sample=5, recall=1.0, chunk=16)
    got = by_query(ann.nearest(vectors(spark, rows), F.col("vec_id") % 100 == 0, conf))
    want = brute([x for x in rows if x[0] != 1600], lambda i: i % 100 == 0)
    assert got.keys() == want.keys() == {0, 100, 200}
    assert got[100] == want[100] and got[200] == want[200] and [v for _, v in got[200]] == list(range(100, 110))


def test_few_and_none(spark):
    one = ann.nearest(vectors(spark, [(0, [1.0, 2.0]), (1, [1.0, 3.0])]), F.col("vec_id") % 100 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in one] == [(0, 1, 1, 1.0)]
    assert ann.nearest(vectors(spark, []), F.lit(True)).count() == 0
    assert ann.nearest(vectors(spark, [(1, [1.0])]), F.col("vec_id") % 100 == 0).count() == 0


def test_tree_visits_every_leaf_once():
    r = np.random.default_rng(0)
    rows = np.concatenate([r.normal(size=(500, 8)) + 5 * k for k in range(3)])
    tree = ann.Tree(rows)
    assert set(tree.assign(rows)) <= set(range(tree.leaves))
    order = tree.visit(rows[3], 10_000)
    assert sorted(order) == list(range(tree.leaves)) and order[0] == tree.assign(rows[3:4])[0]
    assert ann.Tree(np.ones((100, 3))).leaves == 1


def test_no_query_has_too_few(spark):
    """Few visits, small leaves, outliers and ids with many vectors: ten rows wherever there are ten candidates."""
    r = np.random.default_rng(5)
    rows = [(k, (r.normal(size=4) / 50 + 9 * (k % 3)).astype(np.float32).tolist()) for k in range(1, 240) if k % 100]
    rows += [(100 * k, [1000.0 * (k + 1), -500.0 * k, 7.0, 1.0]) for k in range(4)]
    conf = ann.Conf(leaf_sample=4, recall=0.01)
    got = by_query(ann.nearest(vectors(spark, rows), F.col("vec_id") % 100 == 0, conf))
    assert {q: len(x) for q, x in got.items()} == {0: 10, 100: 10, 200: 10, 300: 10}
    rows = [(k, r.normal(size=4).astype(np.float32).tolist()) for k in range(40)] + [(k, (1 + r.normal(size=4) / 1000).astype(np.float32).tolist()) for k in (50, 100) for _ in range(30)]
    got = by_query(ann.nearest(vectors(spark, rows), F.col("vec_id") % 100 == 0, ann.Conf(leaf_sample=5, recall=1.0, chunk=16)))
    want = brute(rows, lambda i: i % 100 == 0, 10_000)
    assert got[0][:1] == want[0][:1] and len(got[0]) == len({v for _, v in got[0]}) == len(got[100]) == 10


def test_visits_go_on_until_enough():
    r = np.random.default_rng(0)
    rows = r.normal(size=(500, 8))
    tree = ann.Tree(rows)
    sizes = np.bincount(tree.assign(rows), minlength=tree.leaves)
    order = tree.visit(rows[3], tree.leaves)
    for least in (1, 60, 200, 500, 10_000):
        found = tree.visit(rows[3], 1, sizes, least)
        assert found == order[: len(found)] and (sizes[found].sum() >= least or len(found) == tree.leaves) and sizes[found[:-1]].sum() < least


def test_ids_with_very_many_vectors(spark):
    """A third of all rows share an id; a query's own id and this one crowd its nearest vectors."""
    r = np.random.default_rng(6)
    rows = [(k, r.normal(size=4).astype(np.float32).tolist()) for k in range(1, 300)]
    rows += [(7, (r.normal(size=4) * 0.7).astype(np.float32).tolist()) for _ in range(400)]
    rows += [(100, (1 + r.normal(size=4) / 100).astype(np.float32).tolist()) for _ in range(60)]
    got = by_query(ann.nearest(vectors(spark, rows), F.col("vec_id") % 100 == 0, ann.Conf(leaf_sample=20, recall=1.0, chunk=64)))
    best = {}
    for i, v in rows:
        if i % 100 == 0:
            for j, w in rows:
                if j != i:
                    s = float(np.sqrt(((np.array(w, np.float32).astype(float) - np.array(v, np.float32)) ** 2).sum()))
                    best[i, j] = min(s, best.get((i, j), np.inf))
    for i in (100, 200):
        want = sorted((s, j) for (a, j), s in best.items() if a == i)[:10]
        assert [j for _, j in got[i]] == [j for _, j in want] and np.allclose([s for s, _ in got[i]], [s for s, _ in want], atol=1e-12)


def test_leaves_grow_with_the_input(spark):
    """Large leaves are split again, so that a query's work doesn't grow with the rows; clustered vectors, far more than the sample."""
    r = np.random.default_rng(9)
    centres = r.normal(size=(60, 8)) * 4
    conf = ann.Conf(sample_rows=200, leaf_sample=20, leaf_rows=100, split_sample=60)
    for n in (2_000, 12_000):
        rows = [(k, (centres[k % 60] + r.normal(size=8)).astype(np.float32).tolist()) for k in range(n)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
        entries = ann.classes(ann.usable(df), 11)
        index, forest = ann.indexed(entries, conf)
        sizes = [x.n for x in index.groupBy("leaf").agg(F.count("*").alias("n")).collect()]
        assert max(sizes) <= 100 and sum(sizes) == n and forest.leaves >= n / 100
        got = by_query(ann.nearest(df, F.col("vec_id") % 400 == 0, conf))
        want = brute(rows, lambda i: i % 400 == 0)
        assert sum(len({v for _, v in got[q]} & {v for _, v in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_trees_in_the_place_of_leaves():
    r = np.random.default_rng(1)
    rows = r.normal(size=(900, 3))
    tree = ann.Tree(rows[:100], ann.Conf(leaf_sample=30))
    before = tree.assign(rows)
    parts = {leaf: ann.Tree(rows[before == leaf], ann.Conf(leaf_sample=10)) for leaf in range(0, tree.leaves, 2)}
    n = tree.leaves + sum(p.leaves - 1 for p in parts.values())
    tree.grow(parts)
    after = tree.assign(rows)
    assert tree.leaves == n and sorted(x for x in tree.leaf if x >= 0) == list(range(n))
    for leaf in np.unique(after):
        assert len(set(before[after == leaf])) == 1
    assert sorted(tree.visit(rows[0], 10**6)) == list(range(n))


def test_dimensions_apart(spark):
    """Vectors of different numbers of dimensions have no distance, but each kind is searched."""
    r = np.random.default_rng(2)
    rows = [(k, r.normal(size=(2, 5, 5)[k % 3]).astype(np.float32).tolist()) for k in range(240)]
    got = by_query(ann.nearest(vectors(spark, rows), F.col("vec_id") % 100 == 0, ann.Conf(leaf_sample=5, recall=1.0, chunk=32)))
    for i in (0, 100, 200):
        want = brute([x for x in rows if len(x[1]) == len(rows[i][1])], lambda j, i=i: j == i)[i]
        assert [v for _, v in got[i]] == [v for _, v in want]
