"""Substring deduplication: windows of words that start in an earlier document.

The work is split by content. Each window has an anchor: the leftmost of the
least hashes of its word 8-grams. Equal windows have equal anchors, so all that
can be equal meets in the shard of its anchor, and no document meets a shard it
shares nothing with. Neighbouring windows with the same anchor make one piece of
a document. Only pieces whose anchor stands in two documents or more go on, each
distinct piece once, with the smallest document that holds it.

The pieces of an anchor are ranked by their smallest document. What a piece holds
of an earlier one is found by search: for each binary digit of the ranks, a
shard builds a compressed FM-index (a wavelet matrix with rank directories) of
the pieces whose digit is 0 and streams those whose digit is 1 through it, so
any two pieces of an anchor meet once, the later against an index of the
earlier. Backward search gives the matching statistics; a window that is matched
whole gives an interval of rows, over which the smallest document is found. A
piece's windows also stand in its own smallest document. Each window with a
smallest document is reported to every larger document that holds the piece.

An anchor with more than ``hot_pieces`` distinct pieces (a passage in dozens
of documents, which each have their own words before it) would put them all in
one shard. The windows of such pieces are grouped by two hashes of the whole
window instead, which is exact but for collisions of 128 bits and spreads over
any number of tasks: there, no index is searched.

Windows are judged on the input. Null text has no words. A document with a null
id is never "an earlier document", nor loses words. Rows with the same id are
one document for this comparison. Shorter texts than a window lose nothing; very
long ones are read in stretches of 2 million words, whose pieces overlap by a
window; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .fmindex import FMIndex
from .tokenize import in_chunks

WINDOW = 50
GRAM = 8

#: Distinct pieces from which an anchor's windows are dealt one by one.
HOT_PIECES = 16

#: Words in a shard, about.
SHARD_WORDS = 400_000

_PLACES = 21  # bits of a word's place beside its hash
_MIX = np.uint64(0x9E3779B97F4A7C15)


def finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of a slice of texts in one row: hashes, and the texts' bounds."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = pc.dictionary_encode(lists.flatten())
        self.words = coded.dictionary.to_pylist()
        code = coded.indices.to_numpy(zero_copy_only=False)
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        if "" in self.words:
            real = code != self.words.index("")
            at = np.concatenate([[0], np.cumsum(real)])[at]
            code = code[real]
        self.code, self.bounds = code, at
        from xxhash import xxh64_intdigest

        self.hash = np.array([xxh64_intdigest(w) for w in self.words], np.uint64)[code] if self.words else np.zeros(0, np.uint64)

    def text(self, a: int, b: int) -> str:
        return " ".join([self.words[c] for c in self.code[a:b].tolist()])


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words, by doubling: h(2k) from two of h(k)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    done, size, power = None, 0, h
    width, bit = 1, n
    while bit:
        if bit & 1:
            if done is None:
                done, size = power, width
            else:
                m = min(len(done), len(power) - size)
                done, size = finish(done[:m] * _MIX + power[size : size + m] + np.uint64(size)), size + width
        bit >>= 1
        if bit:
            power = finish(power[:-width] * _MIX + power[width:] + np.uint64(width))
            width *= 2
    return done[: len(h) - n + 1]


def least(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive elements."""
    out, width = x, 1
    while width * 2 <= n:
        out, width = np.minimum(out[:-width], out[width:]), width * 2
    return np.minimum(out[: len(x) - n + 1], out[n - width : n - width + len(x) - n + 1])


def anchors(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchor: (first window, windows, anchor hash)."""
    n = len(h) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    grams = rolled(h, GRAM)
    low = np.uint64((1 << _PLACES) - 1)
    starts, sizes, keys = [], [], []
    # places fit beside the hash; windows that straddle two stretches are in the first
    stretch = (1 << _PLACES) - window
    for a in range(0, n, stretch):
        b = min(n, a + stretch)
        part = grams[a : b + window - GRAM]
        best = least((part & ~low) | np.arange(len(part), dtype=np.uint64), window - GRAM + 1)
        place = (best & low).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        starts.append(new + a)
        sizes.append(np.diff(np.append(new, len(place))))
        keys.append(part[place[new]])
    return np.concatenate(starts), np.concatenate(sizes), np.concatenate(keys)


_ODD = 0xD1342543DE82EF95
_POWERS: dict[str, np.ndarray] = {}


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(name, ())) < n:
        out, size = np.ones(1, np.uint64), 1
        while size < n:
            out = np.concatenate([out, out * np.uint64(pow(base, size, 1 << 64))])
            size *= 2
        _POWERS[name] = out
    return _POWERS[name][:n]


def _powers(n: int) -> np.ndarray:
    """Powers of an odd number modulo 2**64, which has an inverse: the hash of a
    stretch is a difference of two prefix sums, moved to place zero."""
    return _power_table("up", _ODD, n)


def _inverse(n: int) -> np.ndarray:
    return _power_table("down", pow(_ODD, -1, 1 << 64), n)


class Prefix:
    """Hashes of any stretches of a row of words, by differences of prefix sums."""

    def __init__(self, h: np.ndarray):
        self.back = _inverse(len(h) + 1)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * _powers(len(h)), dtype=np.uint64)]) for x in (finish(h), finish(h + _MIX))]

    def hash(self, start: np.ndarray, n: np.ndarray, which: int = 0) -> np.ndarray:
        s = self.sums[which]
        return finish((s[start + n] - s[start]) * self.back[start] + n.astype(np.uint64)).view(np.int64)


RUNS = "doc_id long, start long, windows long, anchor long, piece long"


def runs(docs: DataFrame, window: int) -> DataFrame:
    """All pieces of all documents: first word, number of windows, anchor, hash of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_chunks(batch):
                w, out = Words(part.column("text")), []
                ids = part.column("doc_id").to_numpy()
                for i, (a, b) in enumerate(zip(w.bounds[:-1], w.bounds[1:])):
                    if b - a >= window:
                        h = w.hash[a:b]
                        start, n, key = anchors(h, window)
                        out.append((np.full(len(start), ids[i]), start, n, key.view(np.int64), Prefix(h).hash(start, n + window - 1)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], [c.split()[0] for c in RUNS.split(", ")])

    return docs.mapInArrow(run, RUNS)


TAKEN = "hot boolean, anchor long, piece long, offset long, w1 long, w2 long, lo long, hi long, start long, windows long, text string"


def extract(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Words of the pieces ``wanted`` (doc, start, windows, hot, anchor, piece, hi) from
    one document that has each; of a hot piece the hashes of all its windows."""
    item = F.struct("start", "windows", "hot", "anchor", "piece", "hi")
    of_doc = wanted.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(item).alias("items"))
    joined = docs.select("doc_id", "text").join(of_doc, "doc_id")
    names = [c.split()[0] for c in TAKEN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_chunks(batch):
                w = Words(part.column("text"))
                ids = part.column("doc_id").to_numpy()
                cold, hot = [], []
                for i, items in enumerate(part.column("items")):
                    a, b = w.bounds[i : i + 2]
                    x = pa.RecordBatch.from_struct_array(items.values)
                    start, n, is_hot, anchor, piece, hi = (x.column(c).to_numpy(zero_copy_only=False) for c in ("start", "windows", "hot", "anchor", "piece", "hi"))
                    prefix = Prefix(w.hash[a:b])
                    inside = start + n + window - 1 <= b - a
                    same = np.zeros(len(start), bool)
                    h = prefix.hash(start[inside], n[inside] + window - 1)
                    # of rows with the same id, the one that has the words
                    same[inside] = h == piece[inside]
                    for k in np.flatnonzero(same & ~is_hot):
                        cold.append((anchor[k], piece[k], ids[i], hi[k], start[k], n[k], w.text(a + start[k], a + start[k] + n[k] + window - 1)))
                    if len(k := np.flatnonzero(same & is_hot)):
                        each = np.repeat(k, n[k])
                        off = np.arange(len(each)) - np.repeat(np.cumsum(n[k]) - n[k], n[k])
                        at, size = start[each] + off, np.full(len(each), window)
                        hot.append((anchor[each], piece[each], off, prefix.hash(at, size), prefix.hash(at, size, 1), np.full(len(each), ids[i]), hi[each], at))
                if cold:
                    anchor, piece, lo, hi, start, n, text = map(list, zip(*cold))
                    none = pa.nulls(len(anchor), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([False] * len(anchor)), *map(pa.array, (anchor, piece)), none, none, none, *map(pa.array, (lo, hi, start, n)), pa.array(text, pa.string())], names)
                if hot:
                    cols = [np.concatenate(x) for x in zip(*hot)]
                    m = len(cols[0])
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, bool)), *map(pa.array, cols), pa.array(np.ones(m, np.int64)), pa.nulls(m, pa.string())], names)

    return joined.mapInArrow(run, TAKEN)


FOUND = "anchor long, piece long, found array<struct<offset:long,n:long,lo:long>>"


def shard_index(table: pa.Table, window: int) -> pa.Table:
    """One shard: stream pieces through indexes of earlier ones, and report for each
    the runs of windows whose smallest document is smaller than one that holds the piece."""
    df = table.select(["anchor", "piece", "lo", "hi"]).to_pandas()
    keep = (~df.duplicated(["anchor", "piece"])).to_numpy()
    df, texts = df[keep].reset_index(drop=True), table.column("text").combine_chunks().filter(pa.array(keep))
    lists = pc.split_pattern(texts.cast(pa.large_string()), " ")
    coded = pc.dictionary_encode(lists.flatten())
    flat = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    lo, lengths = df["lo"].to_numpy(), np.diff(at)
    windows = lengths - window + 1
    first = np.cumsum(windows) - windows
    result = np.repeat(lo, windows)
    ranked = df.sort_values(["lo", "piece"], kind="stable").groupby("anchor")
    rank, size = ranked.cumcount().sort_index().to_numpy(), df.groupby("anchor")["lo"].transform("size").to_numpy()
    for level in reversed(range(int(size.max() - 1).bit_length())):
        half = rank >> level
        indexed = np.flatnonzero((half & 1 == 0) & ((half + 1) << level < size))
        streamed = np.flatnonzero(half & 1 == 1)
        index = FMIndex([flat[at[i] : at[i + 1]] for i in indexed], len(coded.dictionary) + 1, window)
        of, bounds = index.classes(window)
        owner = np.repeat(indexed, index.lengths + 1)
        least_doc = np.minimum.reduceat(lo[np.append(owner, indexed[-1])[index.order]], bounds[:-1])
        for live, place, n, row in index.statistics([flat[at[i] : at[i + 1]] for i in streamed], window):
            whole = n >= window
            spot = first[streamed[live[whole]]] + place[whole]
            result[spot] = np.minimum(result[spot], least_doc[of[row[whole]]])
    # runs of windows with the same smallest document
    who = np.repeat(np.arange(len(df)), windows)
    new = np.flatnonzero(np.concatenate([[True], (result[1:] != result[:-1]) | (who[1:] != who[:-1])]))
    size = np.diff(np.append(new, len(result)))
    use = result[new] < df["hi"].to_numpy()[who[new]]
    new, size = new[use], size[use]
    of_piece = who[new]
    offset = new - first[of_piece]
    some, start = np.unique(of_piece, return_index=True)
    lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(new)), pa.int32()), pa.StructArray.from_arrays([pa.array(offset), pa.array(size), pa.array(result[new])], ["offset", "n", "lo"]))
    return pa.table({"anchor": pa.array(df["anchor"].to_numpy()[some]), "piece": pa.array(df["piece"].to_numpy()[some]), "found": lists})


def repeated_windows(docs: DataFrame, window: int = WINDOW, hot_pieces: int = HOT_PIECES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, spans): word spans [a, b) of each document that windows cover which
    also start in a smaller document. A window has at least GRAM words."""
    if window < GRAM:
        raise ValueError(f"a window of {window} words is shorter than an anchor of {GRAM}")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    every = materialize(runs(docs, window), "runs")
    shared = every.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo != hi").select("anchor")
    # written first: a join in the stage of that aggregate could not split a hot anchor
    held = materialize(every.join(materialize(shared, "shared-anchors"), "anchor", "left_semi"), "shared-runs")
    discard(every)
    pieces = held.groupBy("anchor", "piece").agg(F.min("doc_id").alias("doc"), F.max("doc_id").alias("hi"), F.min_by("start", "doc_id").alias("start"), F.first("windows").alias("windows"))
    pieces = materialize(pieces, "pieces")
    many = materialize(pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).select("anchor", (F.col("c") > hot_pieces).alias("hot")), "anchor-pieces")
    taken = materialize(extract(docs, pieces.join(many, "anchor"), window), "piece-words")
    discard(pieces, many)

    columns = ["anchor", "piece", "lo", "hi", "text"]
    words = taken.filter("not hot").agg(F.coalesce(F.sum(F.col("windows") + window - 1), F.lit(0))).first()[0]
    shards = max(1, -(-words // shard_words))
    dealt = taken.filter("not hot").select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), *columns)
    found = materialize(dealt.groupBy("shard").applyInArrow(lambda t: shard_index(t, window), FOUND), "found")

    # windows of hot pieces: the smallest document of each that stands in two or more;
    # written first, so that the join can split a window that stands in many
    spread = taken.filter("hot")
    again = spread.groupBy("w1", "w2").agg(F.min("lo").alias("doc"), F.max("hi").alias("last")).filter("doc != last")
    again = materialize(again.select("w1", "w2", "doc"), "hot-windows")
    # a piece has at most window - GRAM + 1 windows
    of_hot = spread.join(again, ["w1", "w2"]).groupBy("anchor", "piece").agg(F.collect_list(F.struct("offset", F.lit(1).cast("long").alias("n"), F.col("doc").alias("lo"))).alias("found"))
    verdicts = found.unionByName(of_hot)
    hits = held.join(verdicts, ["anchor", "piece"])
    mine = F.filter("found", lambda x: x["lo"] < F.col("doc_id"))
    spans = F.transform(mine, lambda x: F.struct((F.col("start") + x["offset"]).alias("a"), (F.col("start") + x["offset"] + x["n"] + (window - 1)).alias("b")))
    return hits.select("doc_id", spans.alias("s")).filter(F.size("s") > 0).groupBy("doc_id").agg(F.flatten(F.collect_list("s")).alias("spans"))


def covered(spans: pa.Array, i: int, n: int) -> np.ndarray:
    """True for each of n words that a span of row i covers."""
    mark = np.zeros(n + 1, np.int64)
    if spans[i].is_valid:
        x = pa.RecordBatch.from_struct_array(spans[i].values)
        np.add.at(mark, np.minimum(x.column("a").to_numpy(), n), 1)
        np.add.at(mark, np.minimum(x.column("b").to_numpy(), n), -1)
    return np.cumsum(mark)[:n] > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, hot_pieces: int = HOT_PIECES, shard_words: int = SHARD_WORDS, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept text) for every row of ``docs``."""
    spans = repeated_windows(docs, window, hot_pieces, shard_words)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(spans, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_chunks(batch):
                out, marks = [], part.column("spans")
                for i, text in enumerate(part.column("text")):
                    words = (text.as_py() or "").encode().split()
                    if marks[i].is_valid:
                        cut = covered(marks, i, len(words)).tolist()
                        kept = [x for x, c in zip(words, cut, strict=True) if not c]
                    else:
                        kept = words
                    joined = b" ".join(kept)
                    out.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else None))
                n, removed, sha, kept_text = zip(*out)
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)] + [pa.array(kept_text)] * with_text
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * with_text)

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text)
