"""Approximate nearest neighbours with a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every vector is then put into a leaf. Leaves that hold too many vectors
are split again by trees fitted on bounded samples of their own, so leaves grow in number with the input, not
in size. A query walks the tree with a priority queue: it goes down to the nearest leaf, keeps the branches it
passed with their distances, and goes on with the nearest of them. How many leaves it visits is calibrated: for
some queries the true neighbours are found by comparing with all vectors, and visits are widened until the
wanted share of them lies in visited leaves. A query whose leaves hold too few ids goes on to the next leaves
until they hold enough. Only rows of visited leaves are compared.

Equal vectors are one entry with its smallest ids, as no query can have more than those among its nearest.
Leaves that stand next to each other share a shelf, and shelves are searched in chunks, so no task holds a
large one whole.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.llm.shared import stored


@dataclass(frozen=True)
class Conf:
    neighbours: int = 10
    branches: int = 8
    sample_rows: int = 20_000  # bound of the vectors that the tree is fitted on
    leaf_sample: int = 40  # sample vectors of a leaf at most, where they can be told apart
    leaf_rows: int = 4096  # entries of a leaf from which it is split again
    split_sample: int = 2000  # about so many entries of a leaf are a sample for that
    most_leaves: int = 200_000  # the tree's bound, as all tasks hold it: a few centres for each leaf
    calibration: int = 100  # bound of the queries whose true neighbours are looked up
    recall: float = 0.97  # that calibration asks for
    chunk: int = 16_384  # entries, and queries, that meet in a task at a time
    rounds: int = 12  # of k-means
    seed: int = 3


class Tree:
    """Inner nodes hold centres and children; leaves are numbered, and may be replaced by trees of their own."""

    def __init__(self, sample: np.ndarray, conf: Conf = Conf()):
        self.centres: list[np.ndarray | None] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        random = np.random.default_rng(conf.seed)
        todo = [(self._node(), np.asarray(sample, np.float64))]
        while todo:
            node, rows = todo.pop()
            near = _kmeans(rows, conf, random) if len(rows) > conf.leaf_sample else None
            if near is None:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            centres, owner = near
            self.centres[node] = centres
            self.children[node] = [self._node() for _ in centres]
            todo += [(child, rows[owner == k]) for k, child in enumerate(self.children[node])]

    def _node(self) -> int:
        self.centres.append(None)
        self.children.append([])
        self.leaf.append(-1)
        return len(self.leaf) - 1

    def grow(self, parts: dict[int, Tree]) -> None:
        """Puts trees in the place of leaves; leaves are numbered anew, from one end of the tree to the other."""
        for node in [n for n, leaf in enumerate(self.leaf) if leaf in parts]:
            part, shift = parts[self.leaf[node]], len(self.leaf) - 1
            at = lambda n, node=node, shift=shift: n + shift if n else node  # noqa: E731  the part's root stands where the leaf was
            for _ in range(len(part.leaf) - 1):
                self._node()
            for n in range(len(part.leaf)):
                self.centres[at(n)], self.children[at(n)], self.leaf[at(n)] = part.centres[n], [at(c) for c in part.children[n]], part.leaf[n]
        self.leaves, todo = 0, [0]
        while todo:
            node = todo.pop()
            todo += self.children[node][::-1]
            if self.centres[node] is None:
                self.leaf[node] = self.leaves
                self.leaves += 1

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child at every node."""
        out, todo = np.empty(len(rows), np.int32), [(0, np.arange(len(rows)))]
        while todo:
            node, some = todo.pop()
            if self.centres[node] is None:
                out[some] = self.leaf[node]
                continue
            owner = _distances(rows[some], self.centres[node]).argmin(axis=1)
            todo += [(child, some[owner == k]) for k, child in enumerate(self.children[node]) if (owner == k).any()]
        return out

    def visit(self, query: np.ndarray, most: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """Leaves in the order of a best-bin-first search: ``most`` of them, and on until they hold ``least`` by ``sizes``."""
        found, queue, held = [], [(0.0, 0)], 0
        while queue and (len(found) < most or sizes is not None and held < least):
            _, node = heapq.heappop(queue)
            while self.centres[node] is not None:
                far = _distances(query[None], self.centres[node])[0]
                order = np.argsort(far, kind="stable")
                for k in order[1:].tolist():
                    heapq.heappush(queue, (float(far[k]), self.children[node][k]))
                node = self.children[node][int(order[0])]
            found.append(self.leaf[node])
            held += 0 if sizes is None else int(sizes[found[-1]])
        return found


class Forest:
    """A tree for each number of dimensions, as vectors of different ones have no distance; leaves are numbered throughout."""

    def __init__(self, trees: dict[int, Tree]):
        self.trees, self.first, self.leaves = dict(sorted(trees.items())), {}, 0
        for d, tree in self.trees.items():
            self.first[d] = self.leaves
            self.leaves += tree.leaves

    def grow(self, parts: dict[int, Tree]) -> None:
        for d, tree in self.trees.items():
            tree.grow({leaf - self.first[d]: part for leaf, part in parts.items() if 0 <= leaf - self.first[d] < tree.leaves})
        self.__init__(self.trees)

    def assign(self, vectors: pa.Array) -> np.ndarray:
        out = np.empty(len(vectors), np.int32)
        for d, some, rows in _by_dimension(vectors):
            out[some] = self.trees[d].assign(rows) + self.first[d]
        return out

    def visit(self, query: np.ndarray, most: int, sizes: np.ndarray | None = None, least: int = 0) -> np.ndarray:
        d = len(query)
        own = None if sizes is None else sizes[self.first[d] : self.first[d] + self.trees[d].leaves]
        return np.array(self.trees[d].visit(query, most, own, least), np.int64) + self.first[d]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, up to rounding."""
    return np.maximum(0, (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None])


def _kmeans(rows: np.ndarray, conf: Conf, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Centres with at least a row each and the centre of each row; None if the rows can't be told apart."""
    centres = rows[random.choice(len(rows), min(conf.branches, len(rows)), replace=False)]
    for _ in range(conf.rounds):
        owner = _distances(rows, centres).argmin(axis=1)
        used = np.unique(owner)
        centres = np.stack([rows[owner == k].mean(axis=0) for k in used])
    owner = _distances(rows, centres).argmin(axis=1)
    used, owner = np.unique(owner, return_inverse=True)
    return (centres[used], owner) if len(used) > 1 else None


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(whole), -1) if len(whole) else flat.reshape(0, 0)


def _by_dimension(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, places, matrix) of the vectors of each number of dimensions."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes).tolist():
        some = np.flatnonzero(sizes == d)
        yield d, some, _matrix(vectors.take(pa.array(some)))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, cid) of the vectors that take part; cid names equal vectors alike.

    Null ids and vectors that are null, empty, zero or hold null or non-finite components take no part.
    """
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.forall("embedding", _finite) & F.exists("embedding", lambda x: x != 0))
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0).cast("float")))  # -0 to 0
    two = F.concat(F.lpad(F.hex(F.xxhash64("embedding")), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), "embedding")), 16, "0"))
    return rows.withColumn("cid", two)


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """(cid, embedding, ids): different vectors with their ``keep`` smallest ids. The rank limit works before the shuffle."""
    w = Window.partitionBy("cid").orderBy("vec_id")
    few = rows.dropDuplicates(["cid", "vec_id"]).withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)
    return few.groupBy("cid").agg(F.first("embedding").alias("embedding"), F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact distances in doubles of rows that stand beside each other."""
    return np.sqrt(((b - a) ** 2).sum(axis=1))


def _nearest(queries: np.ndarray, rows: np.ndarray, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, row) of the ``keep`` nearest rows of each query, with all that rounding or a tie may have put behind them."""
    norms = (rows * rows).sum(1)
    for at in range(0, len(queries), 256):
        some = queries[at : at + 256]
        own = (some * some).sum(1)
        far = norms[None] - 2 * (some @ rows.T) + own[:, None]
        if len(rows) > keep:
            edge = np.partition(far, keep - 1, axis=1)[:, keep - 1]
            q, r = np.nonzero(far <= (edge + 1e-9 * (np.abs(edge) + norms.max() + own))[:, None])
        else:
            q, r = np.divmod(np.arange(far.size), len(rows)) if len(rows) else (np.empty(0, int),) * 2
        yield q + at, r


def _brute(queries: dict[int, tuple[list[int], np.ndarray]], keep: int, kind: pa.DataType):
    """(q, score, embedding, vec_id): each batch's ``keep`` nearest of each query of the same dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            for d, places, rows in _by_dimension(vectors):
                if d not in queries:
                    continue
                numbers, asked = queries[d]
                for q, r in _nearest(asked, rows, keep):
                    take = pa.array(places[r])
                    ids = pc.list_element(batch.column("ids").take(take), 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(numbers, np.int32)[q]), pa.array(_scores(asked[q], rows[r])), vectors.take(take), ids], names=["q", "score", "embedding", "vec_id"]
                    )

    return run


def calibrate(entries: DataFrame, queries: DataFrame, forest: Forest, conf: Conf) -> int:
    """Leaf visits with which the calibration queries reach the wanted recall."""
    sample = [r.embedding for r in queries.orderBy(F.xxhash64("cid")).limit(conf.calibration).collect()]
    if not sample or forest.leaves == len(forest.trees):
        return 1
    asked: dict[int, tuple[list[int], list]] = {}
    for k, v in enumerate(sample):
        asked.setdefault(len(v), ([], []))[0].append(k)
        asked[len(v)][1].append(v)
    kind = entries.schema["embedding"].dataType.simpleString()
    found = entries.mapInArrow(_brute({d: (k, np.array(v, np.float64)) for d, (k, v) in asked.items()}, conf.neighbours + 1, kind), f"q int, score double, embedding {kind}, vec_id long")
    w = Window.partitionBy("q").orderBy("score", "vec_id")
    true = found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= conf.neighbours + 1).collect()  # calibration * (neighbours + 1) rows
    place = [{x: k for k, x in enumerate(forest.visit(np.array(v, np.float64), forest.leaves).tolist())} for v in sample]
    leaf = forest.assign(pa.array([r.embedding for r in true], pa.list_(pa.float64())))
    needed = np.sort([place[r.q][int(x)] for r, x in zip(true, leaf, strict=True) if r.score > 0])
    if not len(needed):
        return 1
    return int(needed[min(len(needed) - 1, int(np.ceil(conf.recall * len(needed))) - 1)]) + 1


def _assigned(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = pa.array(forest.assign(batch.column("embedding")), pa.int32())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cid", "embedding", "ids")), leaf], names=["cid", "embedding", "ids", "leaf"])

    return run


def _part_of(conf: Conf):
    def run(table: pa.Table) -> pa.Table:
        tree = Tree(_matrix(table.column("embedding")), conf)
        return pa.table([table.column("leaf").slice(0, 1), pa.array([pickle.dumps(tree)], pa.binary())], names=["leaf", "tree"])

    return run


def indexed(entries: DataFrame, conf: Conf) -> tuple[DataFrame, Forest]:
    """The entries with their leaves, and the trees. Only samples, and a number for each leaf, reach the driver."""
    dimensions = {r.d: r.n for r in entries.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect()}
    n = sum(dimensions.values())
    thin = F.pmod(F.xxhash64("cid"), F.lit(max(1, n // conf.sample_rows))) == 0
    sample = [r.embedding for r in entries.where(thin).orderBy("cid").limit(conf.sample_rows).select("embedding").collect()]
    forest = Forest({d: Tree(np.array([v for v in sample if len(v) == d], np.float64).reshape(-1, d), conf) for d in dimensions})
    kind = entries.schema["embedding"].dataType.simpleString()
    rows = entries
    while True:
        rows = stored(rows.mapInArrow(_assigned(forest), f"cid string, embedding {kind}, ids array<long>, leaf int"), "index")
        sizes = {r.leaf: r.n for r in rows.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
        large = sorted((leaf for leaf, k in sizes.items() if k > conf.leaf_rows), key=lambda x: -sizes[x])
        large = large[: max(0, conf.most_leaves - forest.leaves) * conf.leaf_sample // conf.split_sample]
        if not large:
            return rows, forest
        shares = rows.sparkSession.createDataFrame([(leaf, conf.split_sample / sizes[leaf]) for leaf in large], "leaf int, share double")  # at most most_leaves rows
        some = rows.join(F.broadcast(shares), "leaf").where(F.xxhash64(F.lit(2), "cid").cast("double") / 2.0**64 + 0.5 < F.col("share")).select("leaf", "embedding")
        parts = {r.leaf: pickle.loads(r.tree) for r in some.groupBy("leaf").applyInArrow(_part_of(conf), "leaf int, tree binary").collect()}
        if all(tree.leaves == 1 for tree in parts.values()):
            return rows, forest
        forest.grow(parts)


def _probing(forest: Forest, visits: int, shelves: int, sizes: np.ndarray, least: int):
    """(cid, embedding, shelf, leaves): the leaves that a query visits, by the shelf they stand on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                owner, shelf, leaves = [], [], []
                for k, v in enumerate(some.column("embedding")):
                    seen = np.sort(forest.visit(np.array(v.as_py(), np.float64), visits, sizes, least))
                    on = seen * shelves // forest.leaves
                    for x in np.unique(on).tolist():
                        owner.append(k)
                        shelf.append(x)
                        leaves.append(seen[on == x].tolist())
                take = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [some.column("cid").take(take), some.column("embedding").take(take), pa.array(shelf, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))],
                    names=["cid", "embedding", "shelf", "leaves"],
                )

    return run


def _first_ids(score: np.ndarray, entry: np.ndarray, ids: list[list[int]], keep: int) -> list[tuple[float, int]] | None:
    """The ``keep`` first (score, id) with different ids among entries in the order of their scores; None if there are fewer."""
    best: dict[int, float] = {}
    for s, e in zip(score.tolist(), entry.tolist(), strict=True):
        if len(best) >= keep and s > last:
            break
        for i in ids[e]:
            best.setdefault(i, s)
        last = s
    return sorted((s, i) for i, s in best.items())[:keep] if len(best) >= keep else None


def _meet(keep: int):
    """(cid, score, vec_id): of each query the ``keep`` nearest ids among the rows of the leaves it visits."""
    names, types = ["cid", "score", "vec_id"], [pa.string(), pa.float64(), pa.int64()]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        left = left.take(pc.sort_indices(left, [("leaf", "ascending")])).combine_chunks()
        ids, cids, vectors = left.column("ids").to_pylist(), right.column("asked").to_pylist(), right.column("asked_embedding").combine_chunks()
        leaf = left.column("leaf").to_numpy()
        here, starts = np.unique(leaf, return_index=True)
        ends = np.append(starts[1:], len(leaf))
        visits = [[] for _ in here]
        for k, seen in enumerate(right.column("leaves")):
            x = seen.values.to_numpy()
            for place in np.searchsorted(here, x[np.isin(x, here)]).tolist():
                visits[place].append(k)
        visits = [np.array(who, np.int64) for who in visits]
        held = left.column("embedding").combine_chunks()

        def compared(asked: np.ndarray, most: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
            """(query, scores, entries, edge) in the order of scores: ``most`` entries of each leaf, or all. Further ones are beyond the edge."""
            qs, rs, ss = [], [], []
            edge = np.full(right.num_rows, np.inf)
            for place, who in enumerate(visits):
                who = who[np.isin(who, asked)]
                if not len(who):
                    continue
                rows = _matrix(held.slice(int(starts[place]), int(ends[place] - starts[place])))
                q = _matrix(vectors.take(pa.array(who)))
                for a, r in _nearest(q, rows, most or len(rows)):
                    qs.append(who[a])
                    rs.append(r + starts[place])
                    ss.append(_scores(q[a], rows[r]))
                    if most and len(rows) > most:
                        cut = np.flatnonzero(np.diff(a, prepend=-1))
                        np.minimum.at(edge, qs[-1][cut], np.maximum.reduceat(ss[-1], cut))
            if not qs:
                return
            q, r, s = np.concatenate(qs), np.concatenate(rs), np.concatenate(ss)
            order = np.lexsort((s, q))
            q, r, s = q[order], r[order], s[order]
            for some in np.split(np.arange(len(q)), np.flatnonzero(np.diff(q)) + 1):
                yield int(q[some[0]]), s[some], r[some], float(edge[q[some[0]]])

        out, short = [], []
        for at in range(0, right.num_rows, 1024):  # what is found so far is held for so many queries
            for k, score, entry, edge in compared(np.arange(at, at + 1024), keep):
                got = _first_ids(score, entry, ids, keep)
                if got is None or got[-1][0] > edge:
                    short.append(k)
                else:
                    out += [(cids[k], s, i) for s, i in got]
        for at in range(0, len(short), 64):  # ids that repeat crowd the nearest: all rows of the visited leaves
            for k, score, entry, _ in compared(np.array(short[at : at + 64]), None):
                best: dict[int, float] = {}
                for s, e in zip(score.tolist(), entry.tolist(), strict=True):
                    for i in ids[e]:
                        best.setdefault(i, s)
                out += [(cids[k], s, i) for s, i in sorted((s, i) for i, s in best.items())[:keep]]
        return pa.table([pa.array([r[k] for r in out], types[k]) for k in range(3)], names=names)

    return run


def nearest(vectors: DataFrame, is_query: Column, conf: Conf = Conf()) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each query row, by Euclidean distance.

    Candidates are all usable rows of as many dimensions with another id than the query's. Ties go to the smaller
    id; with fewer candidates than ``neighbours`` all are returned. Repeated rows count once. An id with several
    vectors is a query, and a candidate, with each of them, the nearer one counting, however many there are.
    Queries that aren't usable have no rows; an empty table gives none. Further columns play no part.
    """
    keep = conf.neighbours + 1  # a query's own id may be among them
    rows = usable(vectors)
    entries = stored(classes(rows, keep), "entries")
    asked = stored(rows.where(is_query).select(F.col("vec_id").cast("long").alias("query_id"), "cid").distinct(), "queries")
    index, forest = indexed(entries, conf)
    queries = index.select("cid", "embedding").join(asked.select("cid").distinct(), "cid", "left_semi")
    visits = calibrate(index, queries, forest, conf)
    kind = entries.schema["embedding"].dataType.simpleString()
    shelves = max(1, min(forest.leaves, -(-index.count() // conf.chunk)))
    index = index.withColumn("shelf", F.expr(f"cast(cast(leaf as long) * {shelves} div {max(1, forest.leaves)} as int)"))
    # ids of a leaf that are nowhere else add up over leaves: so many different ids a query meets at least
    sizes = np.zeros(max(1, forest.leaves), np.int64)
    single = index.select("leaf", F.explode("ids").alias("vec_id")).groupBy("vec_id").agg(F.count("*").alias("n"), F.min("leaf").alias("leaf")).where("n = 1")
    for r in single.groupBy("leaf").agg(F.count("*").alias("n")).collect():  # a number for each leaf
        sizes[r.leaf] = r.n
    probes = stored(queries.mapInArrow(_probing(forest, visits, shelves, sizes, keep), f"cid string, embedding {kind}, shelf int, leaves array<int>"), "probes")
    parts = lambda name: F.ceil(F.count("*") / conf.chunk).cast("int").alias(name)
    # a row for each shelf: at most as many as the tree has leaves, which is bounded
    shape = F.broadcast(index.groupBy("shelf").agg(parts("chunks")).join(probes.groupBy("shelf").agg(parts("blocks")), "shelf"))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(shape, "shelf").withColumn("chunk", deal("cid", "chunks")).withColumn("block", every("blocks"))
    left = left.select("shelf", "chunk", "block", "leaf", "embedding", "ids")
    right = probes.join(shape, "shelf").withColumn("block", deal("cid", "blocks")).withColumn("chunk", every("chunks"))
    right = right.select(F.col("cid").alias("asked"), F.col("embedding").alias("asked_embedding"), "leaves", "shelf", "chunk", "block")
    met = left.groupBy("shelf", "chunk", "block").cogroup(right.groupBy("shelf", "chunk", "block")).applyInArrow(_meet(keep), "cid string, score double, vec_id long")
    # each id once, then the first of them: no more than neighbours and the query's own id are ever needed
    best = met.groupBy("cid", "vec_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("cid").orderBy("score", "vec_id")
    best = best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep).drop("place")
    pairs = asked.join(best, "cid").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= conf.neighbours).select("query_id", "rank", "vec_id", "score")
