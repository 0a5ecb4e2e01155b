"""SimHash near-duplicates by multi-index hashing.

Fingerprints are split into two segments of 32 bits. If two differ in at most
two bits, they differ in at most one bit of the first segment, or in none of
the second. So each distinct fingerprint looks up the codes of the Hamming ball
of radius one round its first segment in the first table, and its second
segment in the second table, and whole distances are verified.

A bucket with many members would give all its pairs. Members of such buckets
are linked another exact way: in a bucket, two fingerprints differ in at most
two bits of the rest if and only if some word lies within one bit of both, so
each member is linked to the smallest fingerprint that shares such a word. That
takes 33 rows a member, however many there are.

Equal fingerprints are one node from the start. Null text, or one without a
word, has fingerprint zero, which is linked like any other. Rows with equal
doc_ids are kept; a null doc_id gets a component but never names one, except
that of a group with no other. A text of any length counts whole, in stretches
of 32,768 shingles. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, discard, materialize
from .components import connected_components
from .substrings import Words, finish, rolled
from .tokenize import in_chunks, release

#: Fixed value: the seed of the shingles' XXH64.
SEED = 42

#: Fingerprints in a bucket from which its members are linked through shared words.
HOT_BUCKET = 16


def fingerprint(text: str | None, shingle: int, words: int = 1) -> list[int]:
    """SimHash of a text's word shingles as signed 64-bit numbers: one, of XXH64,
    or two, of XXH128."""
    from xxhash import xxh64_intdigest, xxh128_digest

    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return [0] * words
    n = max(1, len(tokens) - shingle + 1)
    ones, chunk = np.zeros(64 * words, np.int64), 1 << 15
    for a in range(0, n, chunk):
        part = tokens[a : a + chunk + shingle - 1]
        if len(tokens) < shingle:
            shingles = [b" ".join(tokens)]
        else:
            shingles = map(b" ".join, zip(*(part[k:] for k in range(shingle))))
        if words == 1:
            h = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64).astype("<u8").view(np.uint8)
        else:
            h = np.frombuffer(b"".join(map(xxh128_digest, shingles, repeat(SEED))), np.uint8)
        ones += np.unpackbits(h.reshape(-1, 8 * words), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, bitorder="little").view("<i8").tolist()


#: Columns of a fingerprint, by its number of 64-bit words.
WORDS = {1: ["fp"], 2: ["fp", "fp2"]}


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1) -> DataFrame:
    """(doc_id, fp, ..., text_hash) for each row, over its whole text."""
    names = ["doc_id", *WORDS[words], "text_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle, words) for t in b.column("text")], np.int64).reshape(-1, words)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c) for c in fp.T), b.column("text_hash")], names)
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _first(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, 32)


def _second(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def _ball(segment: Column) -> Column:
    """A 32-bit segment and the 32 that differ from it in one bit."""
    return F.array(segment, *(segment.bitwiseXOR(F.lit(1 << i).cast("long")) for i in range(32)))


def near_links(fps: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Links (a, b) that join exactly the fingerprints of ``fps`` (distinct, column
    fp) whose chains of at most two differing bits join them; each link is at most two bits long."""
    x = F.col("fp")
    tables = fps.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("seg"), _first(x).alias("key")), F.struct(F.lit(1).alias("seg"), _second(x).alias("key")))).alias("t")).select("fp", "t.*")
    sizes = tables.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n"))
    # written and counted: beside an estimate of it the planner could take the probes for the smaller side
    hot = materialize(sizes.filter(F.col("n") > hot_bucket).select("seg", "key"), "hot-buckets")
    hot = F.broadcast(hot) if hot.count() <= MAX_BROADCAST_ROWS else hot.hint("merge")

    probes = fps.select("fp", F.explode(F.concat(F.transform(_ball(_first(x)), lambda k: F.struct(F.lit(0).alias("seg"), k.alias("key"))), F.array(F.struct(F.lit(1).alias("seg"), _second(x).alias("key"))))).alias("t")).select("fp", "t.*")

    # ordinary buckets: fetch the table's matches, verify the whole distance. The planner takes the
    # rows of an explode for one, and would gather 34 rows a fingerprint in the driver to broadcast
    # them; the hint, here and below, has both sides shuffled, whatever their estimate
    ordinary = tables.join(hot, ["seg", "key"], "left_anti")
    fetched = probes.withColumnRenamed("fp", "a").join(ordinary.hint("merge"), ["seg", "key"])
    pairs = fetched.filter((F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= 2) & (F.col("a") != F.col("fp"))).select(F.greatest("a", "fp").alias("a"), F.least("a", "fp").alias("b"))

    # hot buckets: members stand at every word within one bit of the rest of their
    # fingerprint; a fingerprint one bit off the bucket's key stands at its own rest
    at = probes.join(hot, ["seg", "key"])
    first = F.col("seg") == 0
    own = F.when(first, _first(x)).otherwise(_second(x)) == F.col("key")
    rest = F.when(first, _second(x)).otherwise(_first(x))
    spots = at.select("fp", "seg", "key", F.explode(F.when(own, _ball(rest)).otherwise(F.array(rest))).alias("spot"))
    least = spots.groupBy("seg", "key", "spot").agg(F.min("fp").alias("b"), F.max("fp").alias("most"))
    starred = spots.join(least.filter("b != most").drop("most").hint("merge"), ["seg", "key", "spot"]).filter("fp != b").select(F.col("fp").alias("a"), "b")
    starred = starred.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
    return pairs.unionAll(starred).distinct()


def _ball_links(fp: np.ndarray, own: np.ndarray, at: np.ndarray, size: np.ndarray, distance: int) -> list[np.ndarray]:
    """Links (numbers of rows) of groups (first row, rows); ``fp`` has a row's words
    side by side. ``own`` rows stand in the bucket itself, others look it up. Small
    groups give all their links; large ones a forest: a row that was reached isn't
    linked again."""
    small = size <= 64
    out = []
    bits = fp.view(np.uint64)  # the count of a negative number's ones would be that of its absolute value
    gap = lambda a, b: np.bitwise_count(bits[a] ^ bits[b]).sum(axis=-1, dtype=np.int64)
    if small.any():
        group = np.repeat(np.flatnonzero(small), size[small])
        row = np.arange(len(group)) - np.repeat(np.cumsum(size[small]) - size[small], size[small]) + at[group]
        row, group = row[own[row]], group[own[row]]
        a = np.repeat(row, size[group])
        b = np.arange(len(a)) - np.repeat(np.cumsum(size[group]) - size[group], size[group]) + np.repeat(at[group], size[group])
        near = (gap(a, b) <= distance) & (a != b)
        out.append(np.stack([a[near], b[near]]))
    for g in np.flatnonzero(~small):
        mine = own[at[g] : at[g] + size[g]]
        left = np.ones(len(mine), bool)
        for start in np.flatnonzero(mine):
            if not left[start]:
                continue
            left[start], stack = False, [start]
            while stack:
                i = stack.pop()
                # a row that only looks the bucket up is compared with its members
                open_ = np.flatnonzero(left if mine[i] else left & mine)
                hit = open_[gap(at[g] + open_, at[g] + i) <= distance]
                left[hit] = False
                stack.extend(hit.tolist())
                out.append(np.stack([np.full(len(hit), at[g] + i), at[g] + hit]))
    return out


def node(words: int) -> Column:
    """What names a fingerprint: itself, or a 64-bit hash of a longer one."""
    return F.col("fp") if words == 1 else F.xxhash64(*WORDS[words])


def _entries(distance: int, words: int, segments: int) -> Iterator[tuple[int, Column, bool]]:
    """(segment, key, own) of the buckets in which a fingerprint stands (own) or
    only looks for others, so that all links of ``distance`` bits meet."""
    m = words * segments
    a, b = divmod(distance, m)
    edge = [64 * i // segments for i in range(segments + 1)]
    for s in range(m):
        lo, hi = edge[s % segments], edge[s % segments + 1]
        radius = a if s <= b else a - 1
        key = F.shiftrightunsigned(F.col(WORDS[words][s // segments]), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long"))
        for r in range((radius + 1) // 2 + 1 if radius >= 0 else 0):
            for flips in combinations(range(hi - lo), r):
                yield s, key.bitwiseXOR(F.lit(sum(1 << i for i in flips)).cast("long")), r <= radius // 2


def block_links(fps: DataFrame, distance: int, words: int = 1, segments: int = 3) -> DataFrame:
    """Links (a, b), by ``node``, of at most ``distance`` bits, found through balls in
    each of ``segments`` segments of each word.

    Two fingerprints that differ in r = m a + b bits differ in at most a bits of
    one of the first b + 1 of m segments, or in at most a - 1 of another. Segments
    that differ in at most R bits meet in a word that is within R // 2 bits of the
    one and R - R // 2 of the other. So all links are found, whatever the distance.
    Every link has its whole distance verified. Buckets are compared inside a task,
    at a few nanoseconds a pair, and a large one gives out a forest that joins what
    its links would join.
    """
    columns, m = WORDS[words], words * segments
    entries = [F.struct(F.lit(s).alias("seg"), key.alias("key"), F.lit(own).alias("own")) for s, key, own in _entries(distance, words, segments)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None

        def links(cols: list[np.ndarray]):
            seg, key, own = cols[:3]
            fp = np.stack(cols[3:], axis=1)
            new = np.flatnonzero(np.concatenate([[True], (seg[1:] != seg[:-1]) | (key[1:] != key[:-1])]))
            size = np.diff(np.append(new, len(seg)))
            use = (size > 1) & (np.add.reduceat(own.astype(np.int64), new) > 0)
            found = _ball_links(fp, own, new[use], size[use], distance)
            one, two = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(fp[x, k]) for x in (one, two) for k in range(words)], [f"{x}{k}" for x in "ab" for k in range(words)])

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("seg", "key", "own", *columns)]
            if not len(cols[0]):
                continue
            if kept is not None:
                cols = [np.concatenate([k, c]) for k, c in zip(kept, cols)]
            # the last group may go on in the next batch
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            kept = [c[cut:] for c in cols]
            if cut:
                yield links([c[:cut] for c in cols])
        if kept is not None:
            yield links(kept)
        release()

    rows = fps.select(*columns, F.explode(F.array(*entries)).alias("e")).select("e.seg", "e.key", "e.own", *columns)
    dealt = rows.repartition("seg", "key").sortWithinPartitions("seg", "key")
    found = dealt.mapInArrow(run, ", ".join(f"{x}{k} long" for x in "ab" for k in range(words)))
    named = lambda x: F.col(f"{x}0") if words == 1 else F.xxhash64(*(f"{x}{k}" for k in range(words)))
    both = found.select(named("a").alias("x"), named("b").alias("y"))
    return both.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).filter("a != b").distinct()


def components(docs: DataFrame, shingle: int = 3, links: Callable[[DataFrame], DataFrame] = near_links, words: int = 1) -> DataFrame:
    """(doc_id, fp, ..., text_hash, component_id): the smallest doc_id reachable over
    ``links`` (by default of at most two bits)."""
    rows = materialize(fingerprints(docs, shingle, words), "fingerprints")
    named = rows.withColumn("node", node(words))
    distinct = named.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in WORDS[words]))
    fps = materialize(distinct, "distinct-fingerprints")
    roots = connected_components(links(fps.select(*WORDS[words])))
    placed = fps.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = materialize(placed.join(names, "root").select("node", "root", "component_id"), "components")
    return named.join(of_node, "node").select("doc_id", *WORDS[words], "text_hash", "component_id", "root")


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Differing bits of 128 of the pairs that are judged first. Sets of shingles with a Jaccard
#: similarity of 0.8 (a cosine of 8/9) differ in 19.5 on average, give or take four.
NEAR_BITS = 21

#: Most rows of a bucket that are compared with each other in one task.
PART_ROWS = 4096

#: Share of the texts (all, if fewer than SAMPLE_TEXTS) from whose shingles the common ones
#: are told, and most shingles so told. It only sets the order in which shingles are tried.
SAMPLE_SHARE, SAMPLE_TEXTS, COMMON_SHINGLES = 8, 20_000, 1_000_000


def shingled(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, node, fp, fp2, text_hash): ``node`` is a hash of the set of a text's
    shingles, and fp, fp2 its SimHash, each shingle counted once."""
    names = ["doc_id", "node", *WORDS[2], "text_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in in_chunks(batch):
                out = np.zeros((b.num_rows, 3), np.int64)
                for i, ids in enumerate(shingle_sets(b.column("text"), shingle)):
                    out[i, 0] = _set_name(ids)
                    ones = np.zeros(128, np.int64)
                    for a in range(0, len(ids), 1 << 15):
                        h = ids[a : a + (1 << 15)].view(np.uint64)
                        both = np.stack([finish(h), finish(h ^ np.uint64(SEED))], axis=1).astype("<u8").view(np.uint8)
                        ones += np.unpackbits(both, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                    out[i, 1:] = np.packbits(2 * ones > len(ids), bitorder="little").view("<i8")
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c) for c in out.T), b.column("text_hash")], names)
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _set_name(ids: np.ndarray) -> np.int64:
    """What names a set of shingles: a 64-bit hash of it."""
    from xxhash import xxh64_intdigest

    return np.uint64(xxh64_intdigest(ids.tobytes(), SEED)).astype(np.int64)


def shingle_sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The set of each text's shingles as sorted 64-bit hashes; a short text is one shingle."""
    words = Words(pc.ascii_lower(texts))
    grams = rolled(words.hash, shingle).view(np.int64)
    for a, b in zip(words.bounds[:-1], words.bounds[1:]):
        if b - a >= shingle:
            yield np.unique(grams[a : b - shingle + 1])
        else:
            yield rolled(words.hash[a:b], b - a).view(np.int64) if b > a else np.zeros(0, np.int64)


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of whole buckets, from batches that are sorted by their first column."""
    kept: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if not len(cols[0]):
            continue
        last = np.flatnonzero(cols[0] != cols[0][-1])
        cut = last[-1] + 1 if len(last) else 0
        if kept and (cut or kept[-1][0][-1] != cols[0][0]):
            # the bucket that was open ends here
            done = [np.concatenate(x) for x in zip(*kept, [c[:cut] for c in cols], strict=True)]
            kept = [[c[cut:] for c in cols]]
            yield done
        else:
            if cut:
                yield [c[:cut] for c in cols]
            kept.append([c[cut:] for c in cols])
    if kept:
        yield [np.concatenate(x) for x in zip(*kept, strict=True)]


#: Bits of a set's mark, 64 to a column.
MARKS = [f"m{k}" for k in range(8)]


def _mark(ids: np.ndarray) -> np.ndarray:
    """Parities of the members of a set that fall on each of 512 places. Marks of two
    sets differ in no more bits than there are members that only one of them has."""
    at = finish(ids.view(np.uint64)) % np.uint64(64 * len(MARKS))
    return np.packbits(np.bincount(at.astype(np.int64), minlength=64 * len(MARKS)) & 1, bitorder="little").view("<i8")


def _cross_pairs(n: np.ndarray, at: np.ndarray, root: np.ndarray, mark: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """All pairs of a bucket's rows that have different roots and can have a
    similarity of 0.8: ``n`` shingles, of which ``at`` stand before the shared one,
    and ``mark`` (a row each) if given. Rows of the commonest root aren't compared
    with each other."""
    roots, place, count = np.unique(root, return_inverse=True, return_counts=True)
    if len(roots) == 1:
        return
    most = place == count.argmax()
    order = np.concatenate([np.flatnonzero(~most), np.flatnonzero(most)])
    rest = len(order) - count.max()
    n, left, place = n[order], (n - at)[order], place[order]
    bits = None if mark is None else mark[order].view(np.uint64)
    step = max(1, (1 << 18) // len(order))
    for a in range(0, rest, step):
        z = min(a + step, rest)
        # common / (n + m - common) >= 0.8, in whole numbers, with the most that can be common
        can = 9 * np.minimum(left[a:z, None], left[None, a:]) >= 4 * (n[a:z, None] + n[None, a:])
        i, j = np.nonzero(can & (place[a:z, None] != place[None, a:]))
        i, j = i[i < j] + a, j[i < j] + a
        if bits is not None:
            # at least so many members stand in one set only: common <= (n + m - apart) / 2
            apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
            may = n[i] + n[j] >= 9 * apart
            i, j = i[may], j[may]
        yield np.stack([order[i], order[j]])


def first_pairs(nodes: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, fp, fp2) of at most ``distance`` differing bits
    that share 32 bits in a row (of eight such stretches): a forest of them.

    A stretch of 32 bits keeps the buckets of unlike texts small at any number of
    rows. A large bucket, of copies, is dealt in parts, each with the bucket's
    smallest member, so no task holds one whole."""
    quarter = [F.shiftrightunsigned(F.col(c), 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long")) for c in WORDS[2] for i in range(4)]
    keys = [quarter[s].bitwiseOR(F.shiftleft(quarter[(s + 1) % 8], 16)).bitwiseOR(F.lit(s << 56).cast("long")) for s in range(8)]
    entries = nodes.select("node", "fp", "fp2", F.explode(F.array(*keys)).alias("key"))
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "fp", "fp2")).alias("head")).filter("n > 1")
    shared = entries.join(materialize(sizes, "buckets"), "key")
    part = F.xxhash64("key", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / PART_ROWS)))
    names = ["key", "node", "fp", "fp2", "h", "h1", "h2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, *cols in _runs(batches, names):
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            node, fp, fp2 = (np.insert(x, new, h[new]) for x, h in zip(cols[:3], cols[3:], strict=True))
            size = np.diff(np.append(new, len(key))) + 1
            yield _named(node, _ball_links(np.stack([fp, fp2], axis=1), np.ones(len(node), bool), np.cumsum(size) - size, size, distance))
        release()

    return _dealt(shared.select(part.alias("key"), "node", "fp", "fp2", F.col("head.node").alias("h"), F.col("head.fp").alias("h1"), F.col("head.fp2").alias("h2")), run)


def _named(node: np.ndarray, found: list[np.ndarray]) -> pa.RecordBatch:
    one, two = node[np.concatenate(found, axis=1)] if found else np.zeros((2, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(one, two)), pa.array(np.minimum(one, two))], ["a", "b"])


def _dealt(rows: DataFrame, run: Callable) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").filter("a != b").distinct()


def _common(docs: DataFrame, nodes: int, shingle: int) -> np.ndarray:
    """Shingles of three or more texts of a sample, the most common last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in in_chunks(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(list(shingle_sets(b.column("text"), shingle))))], ["id"])

    hashed = docs.select(F.xxhash64("text").alias("text_hash"), "text").filter(F.pmod("text_hash", F.lit(max(1, min(SAMPLE_SHARE, nodes // SAMPLE_TEXTS)))) == 0)
    texts = hashed.groupBy("text_hash").agg(F.first("text").alias("text")).select("text")
    counts = texts.mapInArrow(run, "id long").groupBy("id").count().filter("count > 2")
    top = counts.orderBy(F.desc("count"), "id").limit(COMMON_SHINGLES).select("id").toArrow()
    return top.column("id").to_numpy()[::-1].copy()


def rare_pairs(docs: DataFrame, nodes: DataFrame, common: np.ndarray, shingle: int, part_rows: int = PART_ROWS) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, root, text_hash) with different roots, among them
    all that have a similarity of 0.8 or more.

    Two sets with that similarity share one of the first n - ceil(0.8 n) + 1 of
    each one's n members, in any order that is the same for all sets. Here
    ``common`` shingles come last, so that a shared passage seldom makes a pair.
    Most of these shingles stand in one set only; the others' sets meet with their
    marks, which leave out most pairs of less similarity before they are named.
    A bucket of more than ``part_rows`` rows is cut in parts, and each pair of
    parts is a unit of work of its own."""
    names, place = ["key", "node", "root", "n", "at", *MARKS], np.argsort(common)
    ids_sorted = common[place]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in in_chunks(batch):
                keys, size, many, nodes, marks = [], [], [], [], []
                for ids in shingle_sets(b.column("text"), shingle):
                    n = len(ids)
                    rank = np.zeros(n, np.int64)
                    if len(common):
                        k = np.minimum(np.searchsorted(ids_sorted, ids), len(common) - 1)
                        rank = np.where(ids_sorted[k] == ids, place[k] + 1, 0)
                    first = ids[np.argsort(rank, kind="stable")[: n - (4 * n + 4) // 5 + 1]] if n else ids
                    keys.append(first)
                    size.append(n)
                    many.append(len(first))
                    nodes.append(_set_name(ids))
                    marks.append(_mark(ids))
                if sum(many):
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *many]), pa.int32()), pa.array(np.concatenate(keys)))
                    cols = [pa.array(np.array(nodes)), pa.array(np.array(size, np.int32)), lists, *(pa.array(c.copy()) for c in np.stack(marks).T)]
                    yield pa.RecordBatch.from_arrays(cols, ["node", "n", "keys", *MARKS])
        release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, root, *rest in _runs(batches, names):
            (n, at), mark = (x.astype(np.int64) for x in rest[:2]), np.stack(rest[2:], axis=1)
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size, found = np.diff(np.append(new, len(key))), []
            for i, k in zip(new[size > 1], size[size > 1]):
                part = slice(i, i + k)
                found += [i + p for p in _cross_pairs(n[part], at[part], root[part], mark[part])]
            yield _named(node, found)
        release()

    # a set's shingles stay in one row until they are compared; copies meet before they are dealt out
    sets = docs.select("text").mapInArrow(prefixes, ", ".join(["node long", "n int", "keys array<long>", *(f"{m} long" for m in MARKS)]))
    sets = sets.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "keys", *MARKS)))
    sets = materialize(sets.join(nodes.select("node", "root"), "node"), "rare-shingles")
    # a node alone is its own root, so that the difference of both packs well
    entries = sets.select("node", F.col("node").bitwiseXOR(F.col("root")).alias("to_root"), "n", F.posexplode("keys").alias("at", "key"))
    shared = materialize(entries.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "shared-shingles")
    met = materialize(entries.join(shared, "key"), "shared-entries")
    parts = F.ceil(F.col("rows") / part_rows)
    mine = F.pmod(F.xxhash64("node"), parts)
    cut = met.join(sets.select("node", *MARKS), "node").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    cut = cut.withColumn("key", F.xxhash64("key", F.least(mine, "other"), F.greatest(mine, "other"))).withColumn("root", F.col("node").bitwiseXOR(F.col("to_root")))
    pairs = materialize(_dealt(cut.select(*names), run), "candidates")
    discard(sets, shared, met)
    return pairs


def _texts(docs: DataFrame, nodes: DataFrame, *more: str) -> DataFrame:
    """(node, ..., text), one text of each node; copies meet before they are dealt out."""
    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(nodes.select("text_hash"), "text_hash", "left_semi")
    distinct = texts.groupBy("text_hash").agg(F.first("text").alias("text"))
    return distinct.join(nodes.select("node", "text_hash", *more), "text_hash").select("node", *more, "text")


def similar(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """Those of ``pairs`` whose sets of shingles have a Jaccard similarity of 0.8 or more."""
    # written, so that a small table of them can go to the texts instead of all texts to it
    used = materialize(nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", "text_hash"), "used")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in in_chunks(batch):
                sets = list(shingle_sets(b.column("text"), shingle))
                ends = np.cumsum([0, *map(len, sets)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([b.column("node"), lists], ["node", "ids"])
        release()

    sets = materialize(_texts(docs, used).mapInArrow(run, "node long, ids array<long>"), "shingle-sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("ids").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("ids").alias("y")), "b")
    total, common = F.size("x") + F.size("y"), F.size(F.array_intersect("x", "y"))
    # common / (total - common) >= 0.8, in whole numbers
    out = materialize(both.filter(9 * common >= 4 * total).select("a", "b"), "similar")
    discard(used, sets)
    return out


def deduplicate(docs: DataFrame, shingle: int = 5, distance: int = NEAR_BITS) -> DataFrame:
    """One document of each group stays: that with the smallest doc_id (a null
    one only where there is no other), and one of equal rows. Columns are kept.

    Groups are chains of pairs whose sets of shingles have a Jaccard similarity of
    0.8 or more: all such pairs, and no other. A first round takes candidates of at
    most ``distance`` bits from 128-bit fingerprints and judges them, so that the
    second, which finds all that are left by their rare shingles, need not pair a
    large group's members with each other.

    Null texts and those without a word are one group. A text of any length counts
    whole. Shingles are compared by 64-bit hashes."""
    rows = materialize(shingled(docs.select("doc_id", "text"), shingle), "fingerprints")
    nodes = materialize(rows.groupBy("node").agg(F.min("fp").alias("fp"), F.min("fp2").alias("fp2"), F.min("text_hash").alias("text_hash")), "shingle-nodes")
    links = similar(docs, nodes, materialize(first_pairs(nodes, distance), "candidates"), shingle)
    placed = materialize(nodes.join(connected_components(links), "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    common = _common(docs, nodes.count(), shingle)
    left = rare_pairs(docs, placed, common, shingle)
    roots = connected_components(links.unionAll(similar(docs, nodes, left, shingle)))
    of = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = of.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("r"))
    keep = first.select(F.coalesce("r.doc_id", F.lit(0)).alias("_id"), F.col("r.last").alias("_null"), F.col("r.text_hash").alias("_hash"))
    keyed = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_null": F.col("doc_id").isNull(), "_hash": F.xxhash64("text")})
    return keyed.join(keep, ["_id", "_null", "_hash"], "left_semi").dropDuplicates(["_id", "_null", "_hash"]).select(*docs.columns)
