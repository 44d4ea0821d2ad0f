"""The k most similar vectors for every vector, by a hash-prefix forest.

Every tree keeps its vectors as an array sorted by a long hash string (signs of random projections), so the
vectors with a common prefix are one run of that array. A search descends in every tree to the longest prefix
whose runs, of all trees together, hold enough candidates: all trees stop at one length, so going back from full
strings they ascend in step, and the length differs from vector to vector with the density around it.

Two levels make it scale: outer trees range-partition their sorted arrays over the cluster, and each range of some
thousand vectors is searched by an inner forest in memory. The number of outer trees follows the number of
ranges: the longer the prefix that a range stands for, the likelier one tree parts two neighbours. All kept
candidates are scored exactly and only k rows per vector and outer tree leave a task.

Exact copies are folded to one representative first, so that a hot vector costs one row and not its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.session import cut

DIM = 64
INNER_TREES = 16
CANDIDATES = 2048  # places of all inner trees together that a vector is compared with, at least
SLACK = 4  # further candidates kept for the exact comparison
BLOCK = 16_384  # vectors a range of an outer tree aims at
LEAST_COSINE, MISS = 0.9, 0.003  # outer trees part neighbours of this cosine with at most this probability
BITS = 60
SEED = 20250101


def outer_trees(ranges: int, cosine: float = LEAST_COSINE, miss: float = MISS) -> int:
    """How many trees of ``ranges`` ranges keep two vectors of that cosine together in one at least, but for ``miss``.

    One hyperplane leaves them on one side with probability 1 - angle / pi, and log2(ranges) planes make the ranges.
    """
    together = (1 - acos(cosine) / pi) ** log2(max(ranges, 1))
    return 1 if together >= 1 - miss else ceil(log(miss) / log(1 - together))


def _planes(seed: int, dim: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, BITS))


def _hashes(unit: np.ndarray, seed: int) -> np.ndarray:
    """One integer a vector whose bits, from the highest, are the characters of its hash string."""
    return ((unit @ _planes(seed, unit.shape[1]).astype(unit.dtype)) > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def usable(embedding: Column, dim: int = DIM) -> Column:
    """Exactly ``dim`` finite numbers, not all zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(embedding) == dim) & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # against overflow of the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _runs(codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of one sorted array whose strings share their first ``length`` characters."""
    prefix = codes >> np.int64(BITS - length)
    edges = np.flatnonzero(prefix[1:] != prefix[:-1]) + 1
    return np.r_[0, edges], np.r_[edges, len(codes)]


def _stops(sorted_codes: list[np.ndarray], orders: list[np.ndarray], want: int) -> np.ndarray:
    """For each vector the longest prefix whose runs in all trees together have ``want`` places (0 if none has)."""
    n = len(orders[0])
    stop = np.zeros(n, dtype=np.int64)
    for length in range(1, BITS + 1):
        total = np.zeros(n, dtype=np.int64)
        for codes, order in zip(sorted_codes, orders, strict=True):
            start, end = _runs(codes, length)
            total[order] += np.repeat(end - start, end - start)
        deep = total >= want
        if not deep.any():
            break
        stop[deep] = length
    return stop


def _best(rows: np.ndarray, cols: np.ndarray, sims: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best columns of each row, in order; a pair counts once, equal similarity goes to the smaller column."""
    _, once = np.unique(rows * n + cols, return_index=True)
    rows, cols, sims = rows[once], cols[once], sims[once]
    order = np.lexsort((cols, -sims, rows))
    rows, cols, sims = rows[order], cols[order], sims[order]
    first = np.searchsorted(rows, np.arange(n))
    keep = np.arange(len(rows)) - first[rows] < k
    return rows[keep], cols[keep], sims[keep]


def _compared(x: np.ndarray, rows: np.ndarray, cols: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, similarity) of the pairs that may be among the k best of their row, ``least`` being the k-th so far."""
    sims = x[rows] @ x[cols].T
    sims[rows[:, None] == cols[None, :]] = -np.inf
    bar = least[rows]
    if len(cols) > k and np.isneginf(bar).any():
        bar = np.maximum(bar, np.partition(sims, len(cols) - k, axis=1)[:, len(cols) - k] - np.float32(1e-6))
    r, c = np.nonzero((sims >= bar[:, None]) & (sims > -2))
    s = sims[r, c]
    if len(r) > 8 * k * len(rows):  # many equal ones: those of the smallest number are enough
        order = np.lexsort((cols[c], -np.round(s, 6), r))
        r, c, s = r[order], c[order], s[order]
        keep = np.arange(len(r)) - np.searchsorted(r, np.arange(len(rows)))[r] < k
        r, c, s = r[keep], c[keep], s[keep]
    return rows[r], cols[c], s


def forest_topk(unit: np.ndarray, k: int, trees: int = INNER_TREES, want: int = CANDIDATES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, neighbour, cosine) of the k best neighbours of every row that a forest of sorted hash strings finds.

    Equal cosines are put in order of row number. A run of more than ``want`` places is searched in windows of that
    many around each vector, so equal strings, however many, cost no square.
    """
    n, x = len(unit), unit.astype(np.float32)
    codes = [_hashes(x, seed + 1 + t) for t in range(trees)]
    orders = [np.argsort(c, kind="stable") for c in codes]
    codes = [c[o] for c, o in zip(codes, orders, strict=True)]
    stop = _stops(codes, orders, want)
    least = np.full(n, -np.inf, dtype=np.float32)
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
    for c, order in zip(codes, orders, strict=True):
        found, stop_here = [best], stop[order]
        for length in np.unique(stop_here):
            at = np.flatnonzero(stop_here == length)
            start, end = _runs(c, int(length))
            run = np.searchsorted(start, at, side="right") - 1
            cuts = np.flatnonzero(run[1:] != run[:-1]) + 1
            for places in np.split(at, cuts):
                g = np.searchsorted(start, places[0], side="right") - 1
                lo, hi = start[g], end[g]
                if hi - lo <= want:
                    found.append(_compared(x, order[places], order[lo:hi], least, k + SLACK))
                    continue
                for part in np.array_split(places, -(-len(places) // 256)):
                    window = np.arange(max(lo, part[0] - want // 2), min(hi, part[-1] + want // 2))
                    smallest = np.arange(lo, min(hi, lo + k + 1))
                    found.append(_compared(x, order[part], order[np.union1d(window, smallest)], least, k + SLACK))
        best = _best(*(np.concatenate(f) for f in zip(*found, strict=True)), n, k + SLACK)
        count = np.bincount(best[0], minlength=n)
        full = np.flatnonzero(count == k + SLACK)
        last = np.cumsum(count)[full] - 1
        least[full] = best[2][last] - np.float32(1e-6)
    r, c, _ = best
    exact = np.round(np.einsum("ij,ij->i", unit[r], unit[c]), 12)
    return _best(r, c, exact, n, k)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """A column of lists of ``dim`` numbers without nulls as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _planted(trees: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                raw = _vectors(b.column("embedding"), dim).astype("<f8")
                unit, width = _unit(raw), 8 * dim
                packed = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(np.arange(0, width * (b.num_rows + 1), width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(unit).tobytes())])
                for t in range(trees):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t, np.int32)), pa.array(_hashes(unit, SEED - 1 - t)), b.column("rep"), packed], ["tree", "hash", "rep", "unit"])

    return run


def _searched(k: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("tree").to_numpy(), b.column("rep").to_numpy(), np.frombuffer(b"".join(b.column("unit").to_pylist()), "<f8").reshape(-1, dim)) for b in batches if b.num_rows]
        if not parts:
            return
        tree, rep, unit = (np.concatenate(p) for p in zip(*parts, strict=True))
        for t in np.unique(tree):
            mine = np.flatnonzero(tree == t)
            mine = mine[np.argsort(rep[mine])]  # so the order of rows is that of ids
            r, c, sims = forest_topk(unit[mine], k)
            yield pa.RecordBatch.from_arrays([pa.array(rep[mine][r]), pa.array(rep[mine][c]), pa.array(sims)], ["rep", "other", "sim"])

    return run


def nearest(vectors: DataFrame, id_col: str = "id", vec_col: str = "embedding", k: int = 5, dim: int = DIM) -> DataFrame:
    """id, neighbour, sim, rank: the k most similar other vectors of every usable vector.

    Similarity is the cosine, equal similarity goes to the smaller id. Rows whose vector isn't exactly ``dim``
    finite numbers or is all zero take no part; with fewer than k others all of them come out; an empty table
    gives an empty result. Ids must be unique and not null.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("embedding")).where(F.col("id").isNotNull() & usable(F.col("embedding"), dim))
    v = v.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(7), "embedding")})
    # copies: the representative is the smallest id; the k + 1 smallest ids of a class can be anyone's neighbours.
    # The limit on row_number is applied before the shuffle too, so a hot vector sends k + 1 rows a task.
    first = v.withColumn("copy", F.row_number().over(W.partitionBy("h1", "h2").orderBy("id"))).where(F.col("copy") <= k + 1)
    first = cut(first)
    distinct = first.where("copy = 1").select(F.col("id").alias("rep"), "h1", "h2", "embedding")
    n = distinct.count()
    ranges = max(1, -(-n // BLOCK))
    trees = outer_trees(ranges)
    planted = distinct.select("rep", "embedding").mapInArrow(_planted(trees, dim), "tree int, hash long, rep long, unit binary")
    found = planted.repartitionByRange(ranges * trees, "tree", "hash", "rep").mapInArrow(_searched(k, dim), "rep long, other long, sim double")
    best = found.groupBy("rep", "other").agg(F.max("sim").alias("sim")).withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy(F.desc("sim"), "other"))).where(F.col("r") <= k).drop("r")
    heads = first.select("id", "h1", "h2").join(distinct.select("rep", "h1", "h2"), ["h1", "h2"]).groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    # what the members of a class choose from: their own first copies, then those of the classes near it
    near = best.join(heads.withColumnRenamed("rep", "other"), "other").select("rep", F.col("sim"), "ids")
    own = heads.select("rep", F.lit(1.0).alias("sim"), "ids")
    choice = (
        near.unionByName(own)
        .groupBy("rep")
        .agg(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("sim")).alias("far"), i.alias("id"))))).alias("c"))
        .select("rep", F.slice(F.array_sort("c"), 1, 6 * (k + 1)).alias("c"))
    )
    mine = v.select("id", "h1", "h2").join(distinct.select("rep", "h1", "h2").join(choice, "rep"), ["h1", "h2"])
    ranked = mine.select("id", F.posexplode(F.slice(F.filter("c", lambda x: x["id"] != F.col("id")), 1, k)).alias("pos", "x"))
    return ranked.select("id", F.col("x.id").alias("neighbour"), (-F.col("x.far")).alias("sim"), (F.col("pos") + 1).alias("rank"))


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """id_a < id_b of each pair of which at least one is among the other's neighbours."""
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
