"""Exact top-k by inner product: a ball tree in each shard, branch and bound.

A node is a ball: centre and radius of its vectors. No vector in it can score
more than ``q . centre + |q| radius``. Nodes are taken in the order of that bound
(the largest that any query of the block has), each query leaves a node whose
bound is under its kth score so far, and that score starts at what the query's
first shard gave. Ties are kept open: a bound that equals the kth score stays.

Components are whole numbers, floor(64 x), so scores are exact in doubles as
long as they stay under 2**53; larger ones are computed in 64-bit integers.
See ``vectors`` for rows that take part; a query's own id is no candidate.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import QUERY_ROWS, SHARD_ROWS, Best, Searcher, search, valid

LEAF = 128


@dataclass
class BallTree:
    ids: np.ndarray
    vectors: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    ranges: list[tuple[int, int]]
    children: list[tuple[int, int] | None]

    def dump(self) -> bytes:
        """The nodes, without ids and vectors: leaves have no children."""
        sides = [c or (-1, -1) for c in self.children]
        return b"".join([np.int64(len(sides)).tobytes(), np.array(sides, "<i8").tobytes(), np.array(self.ranges, "<i8").tobytes(), self.radii.astype("<f8").tobytes(), self.centres.astype("<f8").tobytes()])

    @classmethod
    def load(cls, ids: np.ndarray, vectors: np.ndarray, data) -> BallTree:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        whole = np.frombuffer(data, "<i8", 4 * n, 8).reshape(2, n, 2)
        real = np.frombuffer(data, "<f8", -1, 8 + 32 * n)
        sides = [tuple(c) if c[0] >= 0 else None for c in whole[0].tolist()]
        return cls(ids, vectors, real[n:].reshape(n, -1), real[:n], [tuple(r) for r in whole[1].tolist()], sides)

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> BallTree:
        order = np.arange(len(ids))
        centres, radii, ranges, children = [], [], [], []

        def node(a: int, b: int) -> int:
            x = vectors[order[a:b]]
            centre = x.mean(axis=0)
            gap = np.sqrt(((x - centre) ** 2).sum(axis=1))
            at = len(centres)
            centres.append(centre)
            radii.append(gap.max() * (1 + 1e-9))
            ranges.append((a, b))
            children.append(None)
            if b - a > leaf and radii[at] > 0:
                # two far points; the half nearer to each is a child
                p = x[gap.argmax()]
                far = x[((x - p) ** 2).sum(axis=1).argmax()]
                side = np.argsort(x @ (far - p), kind="stable")
                order[a:b] = order[a:b][side]
                mid = (a + b) // 2
                children[at] = (node(a, mid), node(mid, b))
            return at

        node(0, len(ids))
        return cls(ids[order], vectors[order], np.array(centres), np.array(radii), ranges, children)


def find(tree: BallTree, q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> Best:
    best = Best.of(len(q), k)
    norm = np.sqrt((q * q).sum(axis=1))
    whole = np.abs(tree.vectors).max(initial=0) * np.abs(q).max(initial=0) * q.shape[1] >= 2**53

    def bound(node: int, rows: np.ndarray) -> np.ndarray:
        middle = q[rows] @ tree.centres[node]
        return middle + norm[rows] * tree.radii[node] + 1e-9 * (np.abs(middle) + norm[rows] * tree.radii[node]) + 1e-6

    everyone = np.arange(len(q))
    first = bound(0, everyone)
    heap = [(-first.max(initial=-np.inf), 0, everyone, first)]
    while heap:
        _, node, rows, bounds = heapq.heappop(heap)
        on = bounds >= np.maximum(best.kth(), least)[rows]
        rows = rows[on]
        if not len(rows):
            continue
        if tree.children[node] is not None:
            for child in tree.children[node]:
                b = bound(child, rows)
                heapq.heappush(heap, (-b.max(), child, rows, b))
            continue
        a, b = tree.ranges[node]
        for c in range(a, b, 1024):
            x, ids = tree.vectors[c : min(b, c + 1024)], tree.ids[c : min(b, c + 1024)]
            scores = (q[rows].astype(np.int64) @ x.T.astype(np.int64)).astype(np.float64) if whole else q[rows] @ x.T
            scores[q_ids[rows][:, None] == ids[None, :]] = -np.inf
            scores[scores < np.maximum(best.kth(), least)[rows][:, None]] = -np.inf
            some = np.isfinite(scores).any(axis=1)
            if some.any():
                best.add(rows[some], np.broadcast_to(ids, (int(some.sum()), len(ids))), scores[some])
    return best


def _build(ids: np.ndarray, vectors: np.ndarray):
    tree = BallTree.build(ids, vectors)
    return tree.ids, tree.vectors, tree.dump()


def _find(ids: np.ndarray, vectors: np.ndarray, index, *query) -> Best:
    return find(BallTree.load(ids, vectors, index), *query)


def top_k(rows: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 64, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) with whole scores over floor(scale * x)."""
    kept = valid(rows, vec_id, vector, lambda x: F.floor(x * scale).cast("double"))
    out = search(kept, is_query, k, Searcher(_build, _find), shard_rows, query_rows)
    return out.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))
