"""Mixing sources to target weights.

Each source's documents stand in one stream of words, cut into blocks of fixed
length. Targets come from the weights; what a source's cap cuts off is shared
among the others. Output shards have ``SLOTS`` slots of one block. Each shard
draws its source counts from a multinomial distribution whose shares are those
of the targets: each slot draws a source by a pseudorandom number of its own,
and a shard's draws are counted. Prefix sums of the counts over the shards give
a source's slots their index. A source stops at the whole number of blocks that
its target needs, never more than three passes; the slots that it drew beyond
that are drawn again, without replacement, from what the others still need. So
a source's blocks meet its target to half a block (the last block of a stream
may be short), whatever the draws were. An index is mapped through the source's
pseudorandom permutation of block numbers, one for each pass, and slots and the
documents' blocks are joined by (source, block number).

Sources rank by code point, null last, and weigh 1, 2, 3, repeating. A source
without a word has target 0. A null text has no words; repeated rows each have
their place in the stream; a null doc_id sorts first; an empty table mixes to an
empty table; extra columns don't matter; a text of any length is a run of blocks.
No random state is used: reruns agree.

Documents are ordered within a source by a bucket of their id (a null one: of
their text), then by id. There are about sqrt(rows) buckets, so prefix sums need
no window over a whole source; those over shards go by about sqrt(shards) bands.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bounded_broadcast, discard, materialize, word_count

#: A prime: all pseudorandom arithmetic is modulo this, so products fit in 63 bits.
P = 2**31 - 1
CAP = 3
ROUNDS = 12

#: Blocks of an output shard.
SLOTS = 1024

#: Draws that one task makes, about.
_TASK_DRAWS = 1 << 18

#: Cells into which a range is cut to look up intervals by equality.
_CELLS = 1024


@dataclass(frozen=True)
class Mix:
    """counts: each output shard's draws from each source (shard, sid, n), as first drawn;
    pieces: one row for each run of words that a slot takes from a document
    (sid, shard, i, epoch, block, row_start, doc_id, size, first, length), with the
    slot's shard and its index i among its source's slots;
    documents: (doc_id, size, source, source_size, target, sid, row_start, text_hash)."""

    documents: DataFrame
    sources: DataFrame
    counts: DataFrame
    pieces: DataFrame


def constants(seed: int, n: int) -> list[int]:
    """The first n numbers of a multiplicative generator (Lehmer's, multiplier 48271)."""
    out, x = [], (seed * 2654435761 + 12345) % P or 1
    for _ in range(n):
        x = x * 48271 % P
        out.append(x)
    return out


def permuted(df: DataFrame, x: str, n: str, keys: list[str], seed: int, rounds: int = ROUNDS) -> DataFrame:
    """``df`` with column ``x`` (0 <= x < n) replaced by its image under a
    pseudorandom permutation of 0..n-1, one for each value of ``keys``: a
    swap-or-not shuffle, which is a permutation for any n."""
    c = constants(seed, rounds * (len(keys) + 3))
    others = ", ".join(f"`{k}`" for k in df.columns if k != x)
    q = "{df}"
    for r in range(rounds):  # one statement, so that all rounds are analysed at once
        a = c[r * (len(keys) + 3) :]
        key = f"{a[0]}L"
        for k, m in zip(keys, a[3:]):
            key = f"(({key} + `{k}` % {P} * {m}L) % {P})"
        q = f"(SELECT {others}, `{x}`, {key} AS __key FROM {q})"
        q = f"(SELECT *, (__key % `{n}` - `{x}` + `{n}`) % `{n}` AS __other FROM {q})"
        coin = f"((greatest(`{x}`, __other) % {P} * {a[1]}L + __key) % {P} * {a[2]}L % {P}) % 2"
        q = f"(SELECT {others}, if({coin} = 1, __other, `{x}`) AS `{x}` FROM {q})"
    return df.sparkSession.sql(f"SELECT * FROM {q}", df=df)


def uniform(g: str, seed: int) -> Column:
    """A pseudorandom whole number in 0..P-1 for each number: fifth powers, which
    permute the numbers modulo P, of linear maps of it."""
    a = constants(seed, 7)

    def fifth(x: str) -> str:
        square = f"({x} * {x} % {P})"
        return f"({square} * {square} % {P} * {x} % {P})"

    # one lambda a step, so that each is computed once
    x = f"(({g} % {P} * {a[0]}L + {g} div {P} * {a[1]}L + {a[2]}L) % {P})"
    for k in (3, 5):
        x = f"transform(array({x}), x -> ({fifth('x')} * {a[k]}L + {a[k + 1]}L) % {P})[0]"
    return F.expr(x)


def bucket_of(doc_id: Column, other: Column, buckets: int) -> Column:
    """The bucket of an id; a null one's is that of ``other``."""
    a, b = constants(3, 2)
    return F.coalesce((F.pmod(doc_id, F.lit(P)) * F.lit(a).cast("long") + F.lit(b)) % P % buckets, F.pmod(other, F.lit(buckets))).cast("long")


def located(df: DataFrame, x: str, size: Column, intervals: DataFrame, rows: int) -> DataFrame:
    """``df`` joined to the row of ``intervals`` (lo, hi, ...; ``rows`` of them, apart
    from each other) that holds ``x``, a whole number below ``size``: by equality on cells."""
    width = F.greatest(F.ceil(size / _CELLS), F.lit(1)).cast("long")
    cut = intervals.filter("lo < hi").withColumn("__cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    cut = bounded_broadcast(cut, rows + _CELLS)
    return df.withColumn("__cell", F.floor(F.col(x) / width)).join(cut, "__cell").filter((F.col(x) >= F.col("lo")) & (F.col(x) < F.col("hi"))).drop("__cell", "lo", "hi")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) with sid, weight and target. One row a source, so
    the windows here are over the sources, not over their rows.

    Sources meet their caps in order of cap / weight; the level at which what is
    left suffices for the rest is the largest that any of them sees."""
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("sid", (F.row_number().over(rank) - 1).cast("long"))
    s = s.withColumn("weight", (F.col("sid") % 3 + 1).cast("long")).withColumn("cap", F.col("source_size") * CAP)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("__room", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("__left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("__level", F.max(F.col("__room") / F.col("__left")).over(everything))
    return s.withColumn("target", F.least(F.col("cap").cast("double"), F.col("__level") * F.col("weight"))).drop("__room", "__left", "__level", "cap")


def draw(sources: DataFrame, total: int, slots: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The multinomial draws of ``total`` slots from ``sources`` (sid, draws; rows).

    (shard, sid, n): the counts; and (shard, sid, i): each slot's source, and its
    index among its source's slots, 0..draws-1, each once."""
    spark, many = sources.sparkSession, sources.count()
    tasks = max(1, -(-total // _TASK_DRAWS))
    everything = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    # shares of 0..P-1 in proportion to the draws
    edge = lambda c: F.floor(c.cast("double") / F.lit(float(max(1, total))) * P).cast("long")
    upto = sources.select("sid", "draws", F.sum("draws").over(everything).alias("upto"))
    shares = upto.select("sid", edge(F.col("upto") - F.col("draws")).alias("lo"), edge(F.col("upto")).alias("hi"))
    shards = spark.range(0, -(-total // slots), 1, tasks).withColumnRenamed("id", "shard")
    last = F.least((F.col("shard") + 1) * slots, F.lit(total)) - 1
    cast = shards.filter("shard >= 0").select("shard", F.explode(F.sequence(F.col("shard") * slots, last)).alias("g")).select("shard", uniform("g", seed).alias("u"))
    counts = materialize(located(cast, "u", F.lit(P), shares, many).groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n")), "shard-counts")

    # prefix sums over the shards: bands first, then shards within a band
    width = max(1, isqrt(-(-total // slots)))
    banded = counts.withColumn("band", F.floor(F.col("shard") / width))
    before = Window.partitionBy("sid").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = banded.groupBy("sid", "band").agg(F.sum("n").alias("m")).select("sid", "band", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "band").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = banded.select("sid", "band", "shard", "n", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("inner")).join(bands, ["sid", "band"])

    # what a source drew too much, and what it still needs; both add up to the same
    drawn = sources.select("sid", "draws").join(counts.groupBy("sid").agg(F.sum("n").alias("n")), "sid", "left")
    drawn = drawn.select("sid", "draws", F.least("draws", F.coalesce("n", F.lit(0))).alias("kept"), F.greatest(F.coalesce("n", F.lit(0)) - F.col("draws"), F.lit(0)).alias("over"))
    drawn = drawn.withColumn("room", F.col("draws") - F.col("kept"))
    running = lambda c: F.sum(c).over(everything) - F.col(c)
    drawn = materialize(drawn.select("sid", "draws", "kept", "over", "room", running("over").alias("over0"), running("room").alias("room0")), "drawn")
    again = drawn.agg(F.coalesce(F.sum("over"), F.lit(0))).first()[0]

    # an explicit number of tasks: a few rows of counts make many slots
    listed = placed.select("sid", "shard", (F.col("base") + F.col("inner")).alias("a"), "n").repartition(tasks, "sid", "shard")
    listed = listed.select("sid", "shard", F.explode(F.sequence(F.col("a"), F.col("a") + F.col("n") - 1)).alias("i")).join(bounded_broadcast(drawn, many), "sid")
    first = listed.filter("i < draws").select("shard", "sid", "i")
    left = listed.filter("i >= draws").select("shard", (F.col("over0") + F.col("i") - F.col("draws")).alias("j"), F.lit(max(1, again)).cast("long").alias("m"))
    # written before the join: a filter that a join infers would be pushed through all rounds
    left = materialize(permuted(left, "j", "m", [], seed + 1).drop("m"), "drawn-again")
    needed = drawn.select("sid", "kept", "room0", F.col("room0").alias("lo"), (F.col("room0") + F.col("room")).alias("hi"))
    second = located(left, "j", F.lit(max(1, again)), needed, many).select("shard", "sid", (F.col("kept") + F.col("j") - F.col("room0")).alias("i"))
    return counts, first.unionAll(second)


def mix(docs: DataFrame, block: int = 32, seed: int = 11, slots: int = SLOTS) -> Mix:
    """See the module; ``block`` is the number of words in a block."""
    size = word_count(F.col("text"))
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("text", "source").alias("text_hash"), size.alias("size")), "sizes")
    buckets = max(1, isqrt(rows.count()))
    # a source as a join key: null is a source of its own
    keyed = rows.withColumns({"skey": F.coalesce("source", F.lit("")), "snull": F.col("source").isNull(), "bucket": bucket_of(F.col("doc_id"), F.col("text_hash"), buckets)})
    per_bucket = keyed.groupBy("skey", "snull", "bucket").agg(F.sum("size").alias("n"), F.first("source").alias("source"))
    per_bucket = materialize(per_bucket, "bucket-sizes")

    sources = targets(per_bucket.groupBy("source").agg(F.sum("n").alias("source_size")))
    blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    passes = F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(CAP)).cast("long")
    part = F.round((F.col("target") - passes * F.col("source_size")) * blocks / F.greatest("source_size", F.lit(1))).cast("long")
    sources = sources.withColumn("blocks", blocks).withColumn("draws", F.least(passes * blocks + part, CAP * blocks))
    sources = sources.withColumns({"skey": F.coalesce("source", F.lit("")), "snull": F.col("source").isNull()})
    sources = materialize(sources.select("sid", "source", "skey", "snull", "source_size", "weight", "target", "blocks", "draws"), "sources")
    number, total = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("draws"), F.lit(0))).first()
    small = bounded_broadcast(sources, number)

    # global place of every document in its source's stream
    upto = Window.partitionBy("skey", "snull").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_bucket.select("skey", "snull", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    inside = Window.partitionBy("skey", "snull", "bucket").orderBy("doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, ["skey", "snull", "bucket"])
    placed = placed.join(small.select("skey", "snull", "sid", "source_size", "target"), ["skey", "snull"])
    documents = materialize(placed.select("doc_id", "size", "source", "source_size", "target", "sid", (F.col("base") + F.col("inner")).alias("row_start"), "text_hash"), "streams")
    discard(rows, per_bucket)

    counts, drawn = draw(sources, total, slots, seed)
    drawn = drawn.join(small.select("sid", "blocks"), "sid")
    drawn = drawn.select("sid", "shard", "i", "blocks", F.floor(F.col("i") / F.col("blocks")).alias("epoch"), (F.col("i") % F.col("blocks")).alias("block"))
    drawn = materialize(permuted(drawn, "block", "blocks", ["sid", "epoch"], seed).drop("blocks"), "draws")

    spans = documents.filter("size > 0").select("sid", "row_start", "doc_id", "text_hash", "size", F.explode(F.sequence(F.floor(F.col("row_start") / block), F.floor((F.col("row_start") + F.col("size") - 1) / block))).alias("block"))
    a = F.greatest(F.col("block") * block, F.col("row_start"))
    b = F.least((F.col("block") + 1) * block, F.col("row_start") + F.col("size"))
    spans = spans.select("sid", "row_start", "doc_id", "text_hash", "size", F.col("block").cast("long").alias("block"), (a - F.col("row_start")).alias("first"), (b - a).alias("length"))
    return Mix(documents, sources, counts, drawn.join(spans, ["sid", "block"]))


def taken(mixed: Mix) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of the input."""
    got = mixed.pieces.groupBy("sid", "row_start").agg(F.sum("length").alias("taken"))
    d = mixed.documents
    # a document without words shares its place with the next one, and takes nothing
    with_words = d.filter("size > 0").join(got, ["sid", "row_start"], "left")
    columns = ["doc_id", "size", "source_size", "target"]
    return with_words.select(*columns, F.coalesce("taken", F.lit(0)).cast("long").alias("taken")).unionAll(d.filter("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))


def shards(mixed: Mix) -> DataFrame:
    """(shard, sid, n, words): what each output shard holds of each source."""
    return mixed.pieces.groupBy("shard", "sid").agg(F.countDistinct("i").alias("n"), F.sum("length").alias("words"))


def mixed_documents(docs: DataFrame, block: int = 128, seed: int = 11) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: one row for each pass
    that takes any of a document's blocks. A pass that takes all of it keeps the
    text as it is; else the words taken stand in their order, one space between.
    Documents without words are not drawn; n_chars, if there, follows the text.

    Rows with the same id, text and source are one document here, taken as often as
    all of them; where they differ in another column, any of them gives its values."""
    mixed = mix(docs, block, seed)
    parts = mixed.pieces.groupBy("sid", "row_start", "doc_id", "text_hash", "size", "epoch").agg(F.sum("length").alias("n"), F.sort_array(F.collect_list(F.struct("first", "length"))).alias("runs"))
    parts = parts.select(F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__null"), F.col("text_hash").alias("__hash"), "sid", "row_start", "epoch", F.when(F.col("n") < F.col("size"), F.col("runs")).alias("__runs"))
    # equal rows: one of them, times the passes of all
    keyed = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__null": F.col("doc_id").isNull(), "__hash": F.xxhash64("text", "source")}).dropDuplicates(["__id", "__null", "__hash"])
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    cut = F.array_join(F.flatten(F.transform("__runs", lambda r: F.slice(words, (r["first"] + 1).cast("int"), r["length"].cast("int")))), " ")
    joined = keyed.join(parts.select("__id", "__null", "__hash", "__runs"), ["__id", "__null", "__hash"])
    out = joined.withColumn("text", F.when(F.col("__runs").isNull(), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
