"""Exact top-k inner products by a dual-tree search over cover trees.

Every task builds cover trees over blocks of its own rows; the vectors never leave their partition. The queries come
in blocks of bounded size, each indexed by a cover tree too, which travels with the tasks. A pair of a query node and a data node is
dropped when no product below it can reach the worst k-th score of the query node's group. Each partition's best k
merge by a sort within the query.

Vectors whose products fit a long meet that way. The few pairs with a larger vector are filtered by their rounded
products and a bound on the error, and what is left is multiplied in integers of any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import settle, table, tidy

#: vectors in a data block, which a task holds with its tree
DATA_BLOCK = 16_384
#: queries, about, that are collected and broadcast at once: 4,096 x 64 longs are 2 MB
QUERY_BLOCK = 4_096
#: vectors in a leaf
LEAF = 48
#: queries in a leaf: small groups have tighter bounds
QUERY_LEAF = 8
#: components that a data block and a block of queries hold at most, if one vector isn't longer
DATA_CELLS, QUERY_CELLS = 2**22, 2**20
#: vectors with n * max * max below this have products with each other that fit a long; the others are wide
LONG = 2.0**62


class CoverTree:
    """Nodes with a centre, a covering radius and children; leaves hold rows of the vectors.

    A node's centre is one of its vectors and is its first child's centre too (nesting). Further children's centres
    are chosen farthest first until every vector is within half of the node's radius of one (covering), so they stand
    more than that apart (separation), and each vector goes to its nearest. A node stops at FAN_OUT children, which in
    many dimensions comes first. Radii are measured, so bounds hold in any case.
    """

    FAN_OUT = 16

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.v = vectors.astype(np.float64)
        centre: list[int] = []
        radius: list[float] = []
        self.children: list[np.ndarray] = []
        self.rows: list[np.ndarray | None] = []
        todo = [(np.arange(len(vectors)), int(((self.v - self.v.mean(0)) ** 2).sum(1).argmin()), -1)]
        while todo:
            rows, own, parent = todo.pop()
            node = len(centre)
            if parent >= 0:
                self.children[parent] = np.append(self.children[parent], node)
            points = self.v[rows]
            best = np.sqrt(((points - self.v[own]) ** 2).sum(1))
            reach = float(best.max())
            centre.append(own)
            radius.append(reach)
            self.children.append(np.zeros(0, np.int64))
            self.rows.append(rows if len(rows) <= leaf or reach == 0 else None)
            if self.rows[node] is None:
                nearest, centres = np.zeros(len(rows), np.int64), [own]
                while len(centres) < self.FAN_OUT and best.max() > reach / 2:
                    far = int(best.argmax())
                    d = np.sqrt(((points - points[far]) ** 2).sum(1))
                    closer = d < best
                    nearest[closer], best[closer] = len(centres), d[closer]
                    centres.append(int(rows[far]))
                todo += [(rows[nearest == k], c, node) for k, c in enumerate(centres)]
        self.centres = self.v[centre]
        self.radii = np.array(radius)
        self.norms = np.sqrt((self.centres**2).sum(1))


NONE, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Best:
    """The best k (score, vec_id) of each query so far; ties go to the smaller id. Places without one hold NONE, LAST."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), NONE)
        self.id = np.full((n, k), LAST)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        hopeful = (scores >= self.score[rows, -1:]).any(1)
        rows, scores, ids = rows[hopeful], scores[hopeful], ids[hopeful]
        if not len(rows):
            return
        s, i = np.concatenate([self.score[rows], scores], 1), np.concatenate([self.id[rows], ids], 1)
        order = np.lexsort((i, -(s + 1)), axis=1)  # + 1: NONE has no negative
        s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        again = np.zeros(s.shape, bool)
        again[:, 1:] = (s[:, 1:] == s[:, :-1]) & (i[:, 1:] == i[:, :-1]) & (i[:, 1:] != LAST)
        if again.any():  # repeated rows of an id
            s[again], i[again] = NONE, LAST
            order = np.lexsort((i, -(s + 1)), axis=1)
            s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        self.score[rows], self.id[rows] = s[:, : self.k], i[:, : self.k]


def dual_search(qt: CoverTree, q: np.ndarray, q_ids: np.ndarray, dt: CoverTree, d: np.ndarray, d_ids: np.ndarray, best: Best) -> int:
    """Offers to best every product that can matter; returns the number of products computed.

    Each query leaf first goes down to its most promising data leaf, which gives the groups their first k-th scores.
    Then pairs of nodes are opened from the roots, the one with the larger radius first.
    """
    done = 0
    small = q.shape[1] * float(np.abs(q).max()) * float(np.abs(d).max()) < 2**52
    rounding = max(1e-9, q.shape[1] * 2.0**-50)
    members: dict[int, np.ndarray] = {}
    for a in range(len(qt.rows) - 1, -1, -1):  # children stand behind their parents
        members[a] = qt.rows[a] if qt.rows[a] is not None else np.concatenate([members[c] for c in qt.children[a]])

    def bound(a: int, nodes: np.ndarray) -> np.ndarray:
        """No product of a vector below query node a and one below each data node is larger."""
        qn, qr, dn, dr = qt.norms[a], qt.radii[a], dt.norms[nodes], dt.radii[nodes]
        return dt.centres[nodes] @ qt.centres[a] + qn * dr + dn * qr + qr * dr + rounding * (qn + qr) * (dn + dr)

    def worst(a: int) -> float:
        return float(best.score[members[a], -1].min())

    def offer(a: int, leaf: np.ndarray) -> None:
        nonlocal done
        rows = qt.rows[a]
        if small:  # doubles hold these integers exactly, and their product is much faster
            scores = (qt.v[rows] @ dt.v[leaf].T).astype(np.int64)
        else:
            scores = q[rows] @ d[leaf].T
        own = q_ids[rows][:, None] == d_ids[leaf][None, :]
        best.offer(rows, np.where(own, NONE, scores), np.where(own, LAST, d_ids[leaf][None, :]))
        done += scores.size

    dived: dict[int, int] = {}
    for a in range(len(qt.rows)):
        if qt.rows[a] is not None:
            node = 0
            while dt.rows[node] is None:
                node = int(dt.children[node][bound(a, dt.children[node]).argmax()])
            offer(a, dt.rows[node])
            dived[a] = node

    todo = [(0, np.array([0]))]
    while todo:
        a, nodes = todo.pop()
        tops = bound(a, nodes)
        keep = tops >= worst(a)
        nodes, tops = nodes[keep], tops[keep]
        if not len(nodes):
            continue
        inner = np.array([dt.rows[n] is None for n in nodes])
        if qt.rows[a] is None and (not inner.any() or qt.radii[a] >= dt.radii[nodes].max()):
            todo += [(int(c), nodes) for c in qt.children[a]]
        elif inner.any():
            todo.append((a, np.concatenate([nodes[~inner], *(dt.children[n] for n in nodes[inner])])))
        else:
            order = [int(i) for i in np.argsort(-tops) if dived[a] != nodes[i]]
            for at in range(0, len(order), 8):
                part = [i for i in order[at : at + 8] if tops[i] >= worst(a)]
                if not part:
                    break
                offer(a, np.concatenate([dt.rows[nodes[i]] for i in part]))
    return done


def _fewest_copies(ids: np.ndarray, v: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors the ones with the smallest ids, each once: others have the same scores and lose every tie."""
    _, group = np.unique(v, axis=0, return_inverse=True)
    by = np.lexsort((ids, group.ravel()))
    g, i = group.ravel()[by], ids[by]
    own = np.r_[True, (g[1:] != g[:-1]) | (i[1:] != i[:-1])]  # repeated rows of an id take one place
    by, g = by[own], g[own]
    starts = np.r_[0, np.flatnonzero(np.diff(g)) + 1]
    place = np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)]))
    kept = by[place < keep]
    kept = kept[np.argsort(ids[kept], kind="stable")]
    return ids[kept], v[kept]


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id long, e array<double>, unit long): e * unit is floor(scale * x) of each component.

    unit is 1 but for vectors in which scale * x leaves the doubles. Leaves out null ids, null or empty vectors and
    vectors that hold a null or non-finite component.
    """
    x = F.col(embedding)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    huge = F.exists(x, lambda c: F.abs(c.cast("double") * scale) == float("inf"))

    def whole(y):  # doubles from 2**52 on are whole
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)

    e = F.transform(x, lambda c: whole(c.cast("double") * scale))
    part = F.transform(x, lambda c: F.when(F.abs(c.cast("double")) < 2.0**52, whole(c.cast("double") * scale) / scale).otherwise(c.cast("double")))
    return vectors.where(F.col(vec_id).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.coalesce(finite, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.when(huge, part).otherwise(e).alias("e"), F.when(huge, scale).otherwise(1).cast("long").alias("unit")
    )


def _matrix(column: pa.Array, unit: np.ndarray) -> dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]]:
    """By length of the vectors and whether they are wide: their places and a matrix, of Python's integers for wide ones."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        part = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), int(n))
        wide = (np.abs(part.astype(np.float64)).max(1) >= (LONG / n) ** 0.5) | (unit[rows] != 1)
        if not wide.all():
            out[int(n), False] = rows[~wide], part[~wide].astype(np.int64)
        if wide.any():
            m = np.empty((int(wide.sum()), int(n)), object)
            for i, (v, u) in enumerate(zip(part[wide].tolist(), unit[rows[wide]].tolist(), strict=True)):
                m[i] = [round(Fraction(c) * u) for c in v]
            out[int(n), True] = rows[wide], m
    return out


def _rounded(v: np.ndarray) -> np.ndarray:
    """The vectors as doubles of size up to 1, times a power of two."""
    if v.dtype != object:
        return v * 2.0**-62
    unit = 1 << max(abs(c).bit_length() for c in v.flat)
    return np.array([[c / unit for c in row] for row in v.tolist()])


def wide_search(q: np.ndarray, q_ids: np.ndarray, d: np.ndarray, d_ids: np.ndarray, best: dict[int, set], k: int) -> None:
    """Puts into best, by query id, the best k (-score, vec_id) with vectors of any size."""
    qf, df = _rounded(q), _rounded(d)
    names, of = np.unique(d_ids, return_inverse=True)
    # times 4: norms and sums are rounded too; the last term is for what falls below the smallest doubles
    error = 4 * (q.shape[1] + 4) * 2.0**-53
    dn = np.sqrt((df**2).sum(1))
    for i, own in enumerate(q_ids.tolist()):
        near = df @ qf[i]
        slack = error * np.sqrt((qf[i] ** 2).sum()) * dn + q.shape[1] * 2.0**-500
        other = d_ids != own
        low = np.full(len(names), -np.inf)
        np.maximum.at(low, of[other], (near - slack)[other])
        least = np.partition(low, -k)[-k] if len(low) > k else -np.inf  # k other ids reach it
        mine = [int(c) for c in q[i]]
        found = best.setdefault(own, set())
        for j in np.flatnonzero(other & (near + slack >= least)).tolist():
            found.add((-sum(a * int(b) for a, b in zip(mine, d[j], strict=True)), int(d_ids[j])))
        best[own] = set(sorted(found)[:k])  # repeated rows of an id are one


def _sortable(score: int) -> bytes | None:
    """None for a long; else bytes that stand in the order of the scores, from 0x80 on for positive ones."""
    if -(2**63) <= score < 2**63:
        return None
    size = (abs(score).bit_length() + 7) // 8
    out = (0x8000 + size).to_bytes(2) + abs(score).to_bytes(size)
    return out if score > 0 else bytes(255 - b for b in out)


def _searcher(queries: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]], k: int):
    """mapInArrow function over (vec_id, e, unit): the best k of a partition for each query."""

    trees = {key: CoverTree(q, QUERY_LEAF) for key, (_, q) in queries.items() if not key[1]}
    lengths = {n for n, _ in queries}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {key: Best(len(queries[key][0]), k) for key in trees}
        far: dict[int, set] = {}
        held: dict[tuple[int, bool], list] = {}

        def search(key: tuple[int, bool]) -> None:
            n, wide = key
            ids, v = (np.concatenate(x) for x in zip(*held.pop(key), strict=True))
            for other in (False, True):
                if (n, other) in queries:
                    q_ids, q = queries[n, other]
                    if wide or other:
                        wide_search(q, q_ids, v, ids, far, k)
                    else:
                        few, w = _fewest_copies(ids, v, k + 1)
                        dual_search(trees[key], q, q_ids, CoverTree(w), w, few, best[key])

        for batch in batches:
            ids, unit = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for key, (rows, v) in _matrix(batch.column(1), unit).items():
                n, wide = key
                if n in lengths:
                    held.setdefault(key, []).append((ids[rows], v))
                    cells = DATA_CELLS // 8 if wide else DATA_CELLS
                    if sum(len(x) for x, _ in held[key]) >= min(DATA_BLOCK, max(1, cells // n)):
                        search(key)
        for key in list(held):
            search(key)
        for key, b in best.items():
            row, place = np.nonzero(b.id != LAST)
            cells = [pa.array(queries[key][0][row]), pa.array(b.id[row, place]), pa.array(b.score[row, place]), pa.nulls(len(row), pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, ["query_id", "vec_id", "score", "beyond"])
        rows = [(i, c, None if _sortable(-s) else -s, _sortable(-s)) for i, found in far.items() for s, c in found]
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["query_id", "vec_id", "score", "beyond"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of each query with other ids' vectors.

    Both tables have (vec_id long, e array of whole numbers), as ``quantised`` makes them, and may have its unit. Ranks
    are exact for products of any size; score is null for one that no long holds. Ties go to the smaller vec_id. A
    query with fewer than k candidates gets them all, one without candidates no row; vectors meet only vectors of
    their own length. Repeated equal rows of an id count as one; an empty table gives no rows; other columns are ignored.
    Queries are taken in blocks by a hash of their id, so the driver holds one block at a time; each block reads the
    vectors once.
    """
    spark = vectors.sparkSession
    vectors, queries = (t.select("vec_id", "e", F.col("unit") if "unit" in t.columns else F.lit(1).cast("long").alias("unit")) for t in (vectors, queries))
    queries = queries.dropDuplicates(["vec_id"])
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("e")), F.lit(0)).alias("cells")).first()
    blocks = max(1, -(-size.n // QUERY_BLOCK), -(-size.cells // QUERY_CELLS))
    found = []
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        if part.num_rows:
            ids, column, unit = part.column("vec_id").to_numpy(), part.column("e").combine_chunks(), part.column("unit").to_numpy()
            of = {key: (ids[rows], v) for key, (rows, v) in _matrix(column, unit).items()}
            best = vectors.mapInArrow(tidy(_searcher(of, k)), "query_id long, vec_id long, score long, beyond binary")
            # of several blocks each is written, so that the driver holds the queries and trees of one only
            found.append(settle(best) if blocks > 1 else best)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    side = F.when(F.col("beyond").isNull(), 0).when(F.col("beyond") >= F.unhex(F.lit("80")), 1).otherwise(-1)
    best = W.partitionBy("query_id").orderBy(side.desc(), F.desc("beyond"), F.desc("score"), "vec_id")
    return out.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best neighbours of every 50th vector among all embeddings."""
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)
