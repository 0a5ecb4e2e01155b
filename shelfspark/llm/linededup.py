"""Cross-site line deduplication by distinct-site spread.

A line is what stands between line feeds; its key is 128 bits of hashes of the
line without spaces, tabs and carriage returns at its ends. Per key, a
HyperLogLog sketch of the sites it stands on is built and merged by aggregation,
so a line of any frequency is one small row per task before the shuffle. Keys
whose estimate is near the threshold get an exact count of distinct sites; the
sketch decides all others. Lines on at least ``min_sites`` sites are
boilerplate: the first occurrence (smallest doc_id, then position) stays, all
others are removed.

Blank lines are never removed. A null site counts for nothing; a null text has
no lines and stays null; a null doc_id sorts first; equal rows are treated
alike; an empty table gives an empty table; extra columns stay as they are. A
text of any length, with any number of lines, is read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Sites from which a line counts as boilerplate.
MIN_SITES = 8

#: log2 of the sketch's registers: a standard error of about 1.6 %.
LG_K = 12

#: Half width of the band round the threshold that is counted exactly: five standard errors, and one site.
BAND = 0.08


def lines_of(docs: DataFrame, text: str = "text", site: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """(doc, row_hash, site, pos, h1, h2): the key of every line that is not blank."""
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    at = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("row_hash"), F.col(site).alias("site"), F.posexplode(trimmed).alias("pos", "line"))
    return at.filter("line != ''").select("doc", "row_hash", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2, first): keys on at least ``min_sites`` sites and where each stands first."""
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min(F.struct("doc", "pos")).alias("first"))
    low, high = min_sites * (1 - BAND) - 1, min_sites * (1 + BAND) + 1
    keys = materialize(sketched.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("estimate")).filter(F.col("estimate") >= low), "spread-lines")
    sure = keys.filter(F.col("estimate") > high)
    near = keys.filter(F.col("estimate") <= high)
    # near the threshold: distinct (line, site) rows, then their exact number
    exact = lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").filter("site is not null").select("h1", "h2", "site").distinct()
    enough = exact.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_sites)
    return sure.select("h1", "h2", "first").unionAll(near.join(enough, ["h1", "h2"]).select("h1", "h2", "first"))


def remove_spread_lines(docs: DataFrame, text: str = "text", site: str = "source", doc_id: str = "doc_id", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with the new text, and columns n_lines and n_removed at the end."""
    # keys and places without the lines themselves, written once and read by each step
    lines_table = materialize(lines_of(docs, text, site, doc_id), "lines")
    spread = materialize(spread_lines(lines_table, min_sites), "boilerplate")
    hits = lines_table.join(spread, ["h1", "h2"]).filter(~(F.col("first.doc").eqNullSafe(F.col("doc")) & (F.col("first.pos") == F.col("pos"))))
    cut = hits.groupBy("doc", "row_hash").agg(F.collect_set("pos").alias("__cut"))
    cut = cut.select(F.coalesce("doc", F.lit(0)).alias("__id"), F.col("doc").isNull().alias("__null"), F.col("row_hash").alias("__hash"), "__cut")
    keyed = docs.withColumns({"__id": F.coalesce(F.col(doc_id), F.lit(0)), "__null": F.col(doc_id).isNull(), "__hash": F.xxhash64(text)})
    joined = keyed.join(cut, ["__id", "__null", "__hash"], "left")
    lines = F.split(F.col(text), "\n")
    # a set difference of the places, so that a text takes time in proportion to its lines
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__cut")
    both = F.array(F.struct(lines.alias("lines"), places.alias("places")))
    kept = F.transform(both, lambda x: F.array_join(F.transform(x["places"], lambda i: x["lines"][i]), "\n"))[0]
    given = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(
        *(F.when(F.col("__cut").isNull(), F.col(text)).otherwise(kept).alias(c) if c == text else F.col(c) for c in given),
        F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("__cut").isNull(), 0).otherwise(F.size("__cut")).cast("long").alias("n_removed"),
    )
