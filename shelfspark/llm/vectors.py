"""Vector tables in shards, and the search of a stated query set against all rows.

Rows are dealt into cells by the planes of a tree that is fitted on a bounded
sample (``SAMPLE`` vectors of each length), so that a shard holds vectors that
are near each other; a cell with more rows than a shard takes is cut by a hash
of the id. Every row is in a shard. A shard's index is built once and written
beside its vectors, with the shard's ball: centre and radius. The balls are one
row for each length of vector, of as many numbers as there are shards times
components; no vector of a shard can score more than its ball allows.

The search has two rounds over blocks of queries. First each query meets the
shard whose ball allows it most; the kth score found there is a lower bound.
Then it goes to those other shards only whose ball may still reach that bound,
and takes the bound along, so that they drop most of their candidates. A search
may choose candidates from an index without its vectors; then these are only
read where something was chosen.

A vector takes part if it and its id are not null, and it has at least one
component and only finite ones. Vectors of different lengths never meet. Of rows
with the same id the one with the smallest vector counts. An empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokenize import release

SHARD_ROWS = 8192
QUERY_ROWS = 1024

#: Vectors of each length, about, on which the planes between cells are fitted, and
#: lengths that get planes, most frequent first; rows of others are dealt by hash.
SAMPLE, FITTED = 8192, 16

BLOCK = "dim int, block long, ids binary, vectors binary"
FOUND = "query_id long, vec_id long, score double"


def valid(rows: DataFrame, vec_id: str, vector: str, transform: Callable[[Column], Column], nonzero: bool = False) -> DataFrame:
    """(vec_id, v, dim): rows that take part, ``transform`` applied to each component."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite)
    if nonzero:
        kept = kept.filter(F.exists("v", lambda x: x != 0))
    one = kept.groupBy("vec_id").agg(F.min("v").alias("v"))
    return one.select("vec_id", F.transform("v", transform).alias("v"), F.size("v").alias("dim"))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """One row (dim, block, ids, vectors) for about ``size`` rows."""
    counts = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / size).alias("blocks"))
    # one row for each length of vector; the plan decides how to join it
    dealt = rows.join(counts, "dim").select("dim", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).alias("block"), "vec_id", "v")

    def pack(table: pa.Table) -> pa.Table:
        dim, block, ids, v = arrays(table, "block")
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([block]), "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([v.tobytes()], pa.binary())})

    return dealt.groupBy("dim", "block").applyInArrow(pack, BLOCK)


def arrays(table: pa.Table, number: str) -> tuple[int, int, np.ndarray, np.ndarray]:
    """dim, number, ids and vectors of a group's rows, by id."""
    table = table.combine_chunks().sort_by("vec_id")
    dim = table.column("dim")[0].as_py()
    v = table.column("v").combine_chunks().flatten().to_numpy()
    return dim, table.column(number)[0].as_py(), table.column("vec_id").to_numpy().astype("<i8"), v.astype("<f8").reshape(-1, dim)


def planes(sample: np.ndarray, cells: int) -> list[tuple[np.ndarray, float]]:
    """Planes of a tree of ``cells`` (a power of two) halves, level by level: at each
    node the half of the sample that is nearer to one of two far points."""
    out, parts = [], [sample]
    for _ in range(cells.bit_length() - 1):
        below = []
        for x in parts:
            far = x[((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax()] if len(x) else np.zeros(sample.shape[1])
            other = x[((x - far) ** 2).sum(axis=1).argmax()] if len(x) else far
            at = x @ (other - far)
            cut = float(np.median(at)) if len(x) else 0.0
            out.append((other - far, cut))
            below += [x[at <= cut], x[at > cut]]
        parts = below
    return out


def cell_of(v: np.ndarray, tree: list[tuple[np.ndarray, float]]) -> np.ndarray:
    cell, level = np.zeros(len(v), np.int64), 0
    while (1 << level) - 1 < len(tree):
        first = (1 << level) - 1
        side = np.zeros(len(v), np.int64)
        for c in range(1 << level):
            at = np.flatnonzero(cell == c)
            direction, cut = tree[first + c]
            side[at] = v[at] @ direction > cut
        cell, level = 2 * cell + side, level + 1
    return cell


def dealt(rows: DataFrame, shard_rows: int) -> DataFrame:
    """``rows`` (vec_id, v, dim) with the number of their shard."""
    large = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard_rows).orderBy(F.desc("n"), "dim").limit(FITTED).collect()
    trees = {}
    for r in large:
        few = rows.filter((F.col("dim") == r.dim) & (F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(-(-r.n // SAMPLE))) == 0)).select("v").toArrow()
        sample = few.column("v").combine_chunks().flatten().to_numpy().reshape(-1, r.dim)
        cells = 1 << min(int(r.n // shard_rows).bit_length(), max(0, len(sample) // 16).bit_length())
        trees[r.dim] = planes(sample, cells)
    sent = rows.sparkSession.sparkContext.broadcast(trees)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int64)
            for dim, tree in sent.value.items():
                if len(at := np.flatnonzero(dims == dim)):
                    cell[at] = cell_of(batch.column("v").take(pa.array(at)).flatten().to_numpy().reshape(-1, dim), tree)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "v", "dim")), pa.array(cell)], ["vec_id", "v", "dim", "cell"])

    placed = rows.select("vec_id", "v", "dim").mapInArrow(place, "vec_id long, v array<double>, dim int, cell long")
    sizes = placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("parts"))
    return placed.join(materialize(sizes, "cells"), ["dim", "cell"]).select("vec_id", "v", "dim", (F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).alias("shard"))


def unpack(dim: int, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<f8").reshape(-1, dim)


@dataclass
class Best:
    """The best k of each query so far: ties go to the smaller id."""

    ids: np.ndarray
    scores: np.ndarray

    @classmethod
    def of(cls, n: int, k: int) -> Best:
        return cls(np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -np.inf))

    def kth(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Offer each of ``rows`` its own candidates (2-d; -inf: none)."""
        ids = np.concatenate([self.ids[rows], ids], axis=1)
        scores = np.concatenate([self.scores[rows], scores], axis=1)
        order = np.lexsort((ids, -scores), axis=-1)[:, : self.ids.shape[1]]
        self.ids[rows] = np.take_along_axis(ids, order, 1)
        self.scores[rows] = np.take_along_axis(scores, order, 1)


@dataclass(frozen=True)
class Searcher:
    """How a shard is indexed and searched.

    ``build(ids, vectors)`` gives (ids, vectors, index), the index as bytes.
    ``find(ids, vectors, index, query ids, queries, lower bounds, k)`` gives a Best.
    ``choose``, if given, gives a bit for each query and row (packed by query, so that what
    is sent is bounded by the sizes of both blocks) without vectors, and
    ``score(ids, vectors, query ids, queries, lower bounds, k, chosen)`` a Best of those."""

    build: Callable
    find: Callable
    choose: Callable | None = None
    score: Callable | None = None


SHARD = "dim int, shard long, centre binary, radius double, ids binary, vectors binary, index binary"
PAIR = "dim int, shard long, home long, q_ids binary, q_vectors binary, least binary"
HOME = "dim int, home long, q_ids binary, q_vectors binary, least binary, f_query binary, f_vec binary, f_score binary"
CHOSEN = "dim int, shard long, q_ids binary, q_vectors binary, least binary, chosen binary"


def _batch(schema: str, *values: object) -> pa.RecordBatch:
    """One row of a schema like those above."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    cells = [v.tobytes() if isinstance(v, np.ndarray) else v for v in values]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[t]) for v, t in zip(cells, types, strict=True)], names)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for r in range(len(batch)):
            row = {c: batch.column(c)[r] for c in batch.schema.names}
            yield {c: x.as_buffer() if pa.types.is_binary(x.type) or pa.types.is_large_binary(x.type) else x.as_py() for c, x in row.items()}


def _queries(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return *unpack(row["dim"], row["q_ids"], row["q_vectors"]), np.frombuffer(row["least"], "<f8")


def _good(best: Best, q_ids: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    who, place = np.nonzero(np.isfinite(best.scores) & (best.scores >= least[:, None]))
    return q_ids[who], best.ids[who, place], best.scores[who, place]


def _found(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])


def route(queries: DataFrame, balls: DataFrame, first: bool) -> DataFrame:
    """Blocks of queries, cut by the shards they go to: at first the one whose ball
    allows a query most, later all others that may reach its lower bound."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            q_ids, q, least = _queries(row)
            shards, radius = np.array(row["shards"]), np.array(row["radii"])
            centre = np.stack([np.frombuffer(x, "<f8") for x in row["centres"]])
            middle, reach = q @ centre.T, np.sqrt((q * q).sum(axis=1))[:, None] * radius[None, :]
            bound = middle + reach + 1e-9 * (np.abs(middle) + reach) + 1e-6
            if first:
                goes = np.zeros(bound.shape, bool)
                goes[np.arange(len(q)), bound.argmax(axis=1)] = True
            else:
                goes = (bound >= least[:, None]) & (shards != row["home"])[None, :]
            for s in np.flatnonzero(goes.any(axis=0)):
                some = goes[:, s]
                yield _batch(PAIR, row["dim"], int(shards[s]), int(shards[s]), q_ids[some], q[some], least[some])

    return queries.join(balls, "dim").mapInArrow(task, PAIR)


def search(rows: DataFrame, is_query: Column, k: int, searcher: Searcher, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of every query over all other rows."""
    rows = materialize(rows, "vectors")

    def index(table: pa.Table) -> pa.Table:
        dim, shard, ids, v = arrays(table, "shard")
        centre = v.mean(axis=0)
        radius = float(np.sqrt(((v - centre) ** 2).sum(axis=1)).max() * (1 + 1e-9))
        return pa.Table.from_batches([_batch(SHARD, dim, shard, centre, radius, *searcher.build(ids, v))])

    shards = materialize(dealt(rows, shard_rows).groupBy("dim", "shard").applyInArrow(index, SHARD), "shards")
    ball = F.array_sort(F.collect_list(F.struct("shard", "centre", "radius")))
    balls = materialize(shards.groupBy("dim").agg(ball.alias("b")).select("dim", F.col("b.shard").alias("shards"), F.col("b.centre").alias("centres"), F.col("b.radius").alias("radii")), "balls")

    def open_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            q_ids, q = unpack(row["dim"], row["ids"], row["vectors"])
            yield _batch(PAIR, row["dim"], -1, -1, q_ids, q, np.full(len(q_ids), -np.inf))

    queries = blocks(rows.filter(is_query), query_rows).mapInArrow(open_bounds, PAIR).drop("shard")

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            q_ids, q, least = _queries(row)
            best = searcher.find(*unpack(row["dim"], row["ids"], row["vectors"]), row["index"], q_ids, q, least, k)
            yield _batch(HOME, row["dim"], row["shard"], q_ids, q, best.kth(), *(np.ascontiguousarray(c) for c in _good(best, q_ids, least)))
        release()

    home = route(queries, balls, first=True).drop("home").join(shards, ["dim", "shard"])
    home = materialize(home.mapInArrow(at_home, HOME), "home")
    pairs = route(home.select("dim", "home", "q_ids", "q_vectors", "least"), balls, first=False).drop("home")

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            q_ids, q, least = _queries(row)
            yield _found(*_good(searcher.find(*unpack(row["dim"], row["ids"], row["vectors"]), row["index"], q_ids, q, least, k), q_ids, least))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            q_ids, q, least = _queries(row)
            chosen = searcher.choose(np.frombuffer(row["ids"], "<i8"), row["index"], q_ids, q, least, k)
            some = np.flatnonzero(chosen.any(axis=1))
            if len(some):
                yield _batch(CHOSEN, row["dim"], row["shard"], q_ids[some], q[some], least[some], chosen[some])
        release()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            q_ids, q, least = _queries(row)
            chosen = np.frombuffer(row["chosen"], np.uint8).reshape(len(q_ids), -1)
            yield _found(*_good(searcher.score(*unpack(row["dim"], row["ids"], row["vectors"]), q_ids, q, least, k, chosen), q_ids, least))
        release()

    if searcher.choose:
        chosen = materialize(pairs.join(shards.select("dim", "shard", "ids", "index"), ["dim", "shard"]).mapInArrow(choose, CHOSEN), "chosen")
        rest = chosen.join(shards.select("dim", "shard", "ids", "vectors"), ["dim", "shard"]).mapInArrow(score, FOUND)
    else:
        rest = pairs.join(shards, ["dim", "shard"]).mapInArrow(elsewhere, FOUND)

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield _found(np.frombuffer(row["f_query"], "<i8"), np.frombuffer(row["f_vec"], "<i8"), np.frombuffer(row["f_score"], "<f8"))

    found = home.select("f_query", "f_vec", "f_score").mapInArrow(unfold, FOUND).unionAll(rest)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
