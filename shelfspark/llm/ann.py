"""Approximate nearest neighbours by inner product: randomly rotated one-bit codes.

In each shard a vector is taken relative to the shard's mean, scaled to length
one and rotated by a fixed random rotation; its code is the signs, packed, with
two correction scalars: the length before scaling, and the inner product of the
rotated vector with its code. A rotated query is rounded to ``LEVELS`` steps and
cut into bit slices, so its inner product with a code is a sum of counted ones
of slice and code. From these an estimate of any inner product follows that
errs, with high probability, by no more than a bound that shrinks with the
number of components, and by no more than the rounding. The estimate plus its
bound chooses vectors for reranking: only those that may still reach the kth
score are fetched and scored on the original vectors, in double precision,
component by component in order. Outside a query's first shard the codes travel
and are compared without the vectors.

Every row is indexed. See ``vectors`` for rows that take part; zero vectors do
not. A query's own id is no candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame

from .vectors import QUERY_ROWS, SHARD_ROWS, Best, Searcher, search, valid

#: Width of the error bound in units of its standard deviation.
EPSILON = 2.5

#: Bits of a query's rounded components.
SLICES = 6
LEVELS = (1 << SLICES) - 1

#: Numbers in one matrix of queries by rows, or of rows by components, at a time.
CELLS = 1 << 20

_ROTATIONS: dict[int, np.ndarray] = {}


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix, the same in every process."""
    if dim not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
        _ROTATIONS[dim] = q * np.sign(np.diag(r))
    return _ROTATIONS[dim]


@dataclass
class Codes:
    centre: np.ndarray
    bits: np.ndarray  # packed signs, in 64-bit words
    length: np.ndarray  # of the vector, relative to the centre
    fit: np.ndarray  # inner product of the scaled, rotated vector with its code

    @classmethod
    def build(cls, vectors: np.ndarray) -> Codes:
        dim = vectors.shape[1]
        centre = vectors.mean(axis=0)
        rel = vectors - centre
        length = np.sqrt((rel * rel).sum(axis=1))
        turned = (rel / np.where(length > 0, length, 1)[:, None]) @ rotation(dim).T
        fit = np.abs(turned).sum(axis=1) / np.sqrt(dim)
        return cls(centre, packed(turned > 0), length, np.where(length > 0, fit, 1))

    def dump(self) -> bytes:
        return b"".join(x.tobytes() for x in (self.centre, self.length.astype("<f4"), self.fit.astype("<f4"), self.bits))

    @classmethod
    def load(cls, n: int, dim: int, data) -> Codes:
        scalars = np.frombuffer(data, "<f4", 2 * n, 8 * dim).astype(np.float64)
        bits = np.frombuffer(data, "<u8", -1, 8 * (dim + n)).reshape(n, -1)
        return cls(np.frombuffer(data, "<f8", dim), bits, scalars[:n], scalars[n:])

    def guess(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of ``q`` (rows) with all vectors, and how far they may be off."""
        n, dim = len(self.length), q.shape[1]
        turned = q @ rotation(dim).T
        low = turned.min(axis=1)
        width = np.maximum((turned.max(axis=1) - low) / LEVELS, 1e-300)
        steps = np.rint((turned - low[:, None]) / width[:, None]).astype(np.int64)
        rounded = np.sqrt(((turned - low[:, None] - steps * width[:, None]) ** 2).sum(axis=1))
        ones = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        dot = np.zeros((len(q), n), np.int32)
        for s in range(SLICES):
            slices = packed((steps >> s) & 1 == 1)
            for w in range(slices.shape[1]):
                dot += np.bitwise_count(slices[:, w][:, None] & self.bits[:, w][None, :]).astype(np.int32) << s
        # the code is +1 or -1: twice the part under its ones, less all
        part = width[:, None] * (2 * dot - steps.sum(axis=1)[:, None]) + low[:, None] * (2 * ones - dim)[None, :]
        norm = np.sqrt((q * q).sum(axis=1))
        scale = self.length / self.fit
        spread = np.sqrt(np.maximum(0, 1 - self.fit**2)) / np.sqrt(max(1, dim - 1)) * EPSILON
        slack = norm[:, None] * (scale * spread)[None, :] + rounded[:, None] * scale[None, :] + 1e-5 * norm[:, None] * scale[None, :]
        return (q @ self.centre)[:, None] + part / np.sqrt(dim) * scale[None, :], slack


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits in 64-bit words."""
    out = np.zeros((len(bits), -(-bits.shape[1] // 64) * 8), np.uint8)
    data = np.packbits(bits, axis=1, bitorder="little")
    out[:, : data.shape[1]] = data
    return out.view("<u8")


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed in the order of the components."""
    out = np.zeros(len(q))
    for a, b in zip(np.ascontiguousarray(q.T), np.ascontiguousarray(x.T)):
        out += a * b
    return out


def find(codes: Codes, ids: np.ndarray, vectors: np.ndarray, q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> Best:
    """The best of a shard whose vectors are at hand."""
    best = Best.of(len(q), k)
    for rows in _parts(len(q), len(ids)):
        part = q[rows]
        estimate, slack = codes.guess(part)
        estimate[q_ids[rows][:, None] == ids[None, :]] = -np.inf
        # those that look best are scored first; their kth score is the bar for the rest
        m = min(4 * k, len(ids))
        top = np.argpartition(-estimate, m - 1, axis=1)[:, :m]
        done = np.zeros(estimate.shape, bool)
        np.put_along_axis(done, top, True, 1)
        _rerank(ids, vectors, best, rows, part, done & np.isfinite(estimate), least)
        bar = np.maximum(best.kth(), least)[rows]
        _rerank(ids, vectors, best, rows, part, (estimate + slack >= bar[:, None]) & ~done & np.isfinite(estimate), least)
    return best


def choose(ids: np.ndarray, index, q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """For each query, the packed bits of the rows that may reach its bar: its lower
    bound, or the kth best that an estimate less its bound promises in this shard."""
    codes, chosen = Codes.load(len(ids), q.shape[1], index), np.zeros((len(q), -(-len(ids) // 8)), np.uint8)
    for rows in _parts(len(q), len(ids)):
        estimate, slack = codes.guess(q[rows])
        estimate[q_ids[rows][:, None] == ids[None, :]] = -np.inf
        bar = least[rows]
        if len(ids) > k:
            bar = np.maximum(bar, -np.partition(slack - estimate, k - 1, axis=1)[:, k - 1])
        chosen[rows] = np.packbits((estimate + slack >= bar[:, None]) & np.isfinite(estimate), axis=1)
    return chosen


def score(ids: np.ndarray, vectors: np.ndarray, q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int, chosen: np.ndarray) -> Best:
    best = Best.of(len(q), k)
    for rows in _parts(len(q), len(ids)):
        wanted = np.unpackbits(chosen[rows], axis=1, count=len(ids)).view(bool)
        _rerank(ids, vectors, best, rows, q[rows], wanted, least)
    return best


def _parts(queries: int, rows: int) -> Iterator[np.ndarray]:
    """Numbers of queries, so many at a time that their matrix with all rows has about ``CELLS`` numbers."""
    step = max(1, CELLS // max(1, rows))
    for a in range(0, queries, step):
        yield np.arange(a, min(a + step, queries))


def _rerank(all_ids: np.ndarray, vectors: np.ndarray, best: Best, rows: np.ndarray, q: np.ndarray, wanted: np.ndarray, least: np.ndarray) -> None:
    """Score the chosen vectors; those that may reach the bar are summed in order."""
    bar = np.maximum(best.kth(), least)[rows]
    who, which = [], []
    for i in np.flatnonzero(wanted.any(axis=1)):
        j = np.flatnonzero(wanted[i])
        s = vectors[j] @ q[i]
        j = j[s >= bar[i] - 1e-9 * (1 + np.abs(s))]
        who.append(np.full(len(j), i))
        which.append(j)
    if who:
        i, j = np.concatenate(who), np.concatenate(which)
        step = max(1, CELLS // q.shape[1])
        for a in range(0, len(i), step):
            part = slice(a, a + step)
            _offer(best, rows, i[part], all_ids[j[part]], exact(q[i[part]], vectors[j[part]]), least)


def _offer(best: Best, rows: np.ndarray, i: np.ndarray, ids: np.ndarray, scores: np.ndarray, least: np.ndarray) -> None:
    keep = scores >= np.maximum(best.kth(), least)[rows[i]]
    i, ids, scores = i[keep], ids[keep], scores[keep]
    if not len(i):
        return
    # the best k of each query among those offered, side by side
    order = np.lexsort((ids, -scores, i))
    i, ids, scores = i[order], ids[order], scores[order]
    who, start = np.unique(i, return_index=True)
    place = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
    k = best.ids.shape[1]
    use = place < k
    row = np.searchsorted(who, i[use])
    wide_ids = np.full((len(who), k), np.iinfo(np.int64).max)
    wide = np.full((len(who), k), -np.inf)
    wide_ids[row, place[use]], wide[row, place[use]] = ids[use], scores[use]
    best.add(rows[who], wide_ids, wide)


def _build(ids: np.ndarray, vectors: np.ndarray):
    return ids, vectors, Codes.build(vectors).dump()


def _find(ids: np.ndarray, vectors: np.ndarray, index, *query) -> Best:
    return find(Codes.load(*vectors.shape, index), ids, vectors, *query)


def nearest(rows: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) with exact scores on the original vectors."""
    kept = valid(rows, vec_id, vector, lambda x: x, nonzero=True)
    out = search(kept, is_query, k, Searcher(_build, _find, choose, score), shard_rows, query_rows)
    return out.select("query_id", "rank", "vec_id", "score")
