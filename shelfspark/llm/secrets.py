"""Secret scans through an incremental blob ledger.

Every version of every path is content-addressed by the SHA-256 of its text
(null: empty). The ledger is a table of (blob, rule_version, findings). A scan
takes the distinct blobs, drops the pairs of blob and rule version that the
ledger has, scans the rest, appends their findings, and joins findings back to
all paths. So a blob is scanned once per rule version, however many paths and
versions hold it and however often the scan is repeated.

All of it is built-in functions. Places of matches come from splitting a text
at a rule's matches: lengths of the parts and of the matches, added up over the
matches as rows, are the places, in code points. A text of any length, with any
number of matches, is scanned whole.

Equal rows are paths of their own and each get the findings; a null path is
kept; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import exists, scratch_path


@dataclass(frozen=True)
class Rule:
    """Leftmost matches that do not overlap; those whose measured part is
    shorter than ``least`` are dropped. ``group`` is the measured part.

    ``long``, if given, matches just those of the pattern's matches that are long
    enough, which saves listing the others."""

    kind: str
    pattern: str
    group: int
    least: int
    long: str | None = None


#: The base rules, in the order in which kinds are listed.
RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32,}"),
)
RULE_VERSION = "base-1"

LEDGER = "blob string, rule_version string, spans array<struct<start:long,kind:int,end:long>>"


MATCH = "array<struct<kind:int,gap:int,n:int,size:int>>"
SPANS = "array<struct<start:long,kind:int,end:long>>"


def matches(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All matches of all rules: the rule's number, the characters between the match
    and the one before it, its length and that of its measured part."""
    found = []
    for k, rule in enumerate(rules):
        pattern = rule.long or rule.pattern
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        part = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group))
        between = F.slice(F.split(text, pattern, -1), 1, F.size(whole))
        rows = F.zip_with(between, F.arrays_zip(whole.alias("w"), part.alias("p")), lambda gap, m: F.struct(F.lit(k).alias("kind"), F.length(gap).alias("gap"), F.length(m["w"]).alias("n"), F.length(m["p"]).alias("size")))
        found.append(F.when(F.rlike(text, F.lit(pattern)), rows.cast(MATCH)).otherwise(F.array().cast(MATCH)))
    return F.concat(*found)


def spans(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) for each row of ``blobs`` (blob, content; distinct): all findings in
    order of start, then of the rules: (start, kind, end).

    Places are running sums over a blob's matches as rows, so any number of them
    in one text takes time in proportion."""
    rows = blobs.select("blob", F.posexplode_outer(matches(F.col("content"), rules)).alias("pos", "m")).select("blob", "pos", "m.*")
    upto = Window.partitionBy("blob", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("n")).over(upto)
    least = F.element_at(F.array(*(F.lit(r.least) for r in rules)), F.col("kind") + 1)
    placed = rows.select("blob", "kind", "n", (F.col("size") >= least).alias("good"), end.alias("end"))
    span = F.when(F.col("good"), F.struct((F.col("end") - F.col("n")).alias("start"), "kind", "end"))
    return placed.groupBy("blob").agg(F.array_sort(F.collect_list(span)).cast(SPANS).alias("spans"))


def named(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each finding, joined by commas."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", kinds[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(versions: DataFrame, path: str = "path", text: str = "text", ledger: str | None = None, rule_version: str = RULE_VERSION, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, spans) for every row of ``versions``; ``ledger`` is a folder
    that grows with each scan (default: a new one in the shared folder)."""
    spark = versions.sparkSession
    ledger = ledger or scratch_path(spark, "blob-ledger")
    content = F.coalesce(F.col(text), F.lit(""))
    blobs = versions.select(F.sha2(content, 256).alias("blob"), content.alias("content"))
    if exists(spark, ledger):
        known = spark.read.schema(LEDGER).parquet(ledger).filter(F.col("rule_version") == rule_version).select("blob").distinct()
        blobs = blobs.join(known, "blob", "left_anti")
    unseen = blobs.groupBy("blob").agg(F.first("content").alias("content"))
    found = spans(unseen, rules).select("blob", F.lit(rule_version).alias("rule_version"), "spans")
    found.write.mode("append").option("compression", "zstd").parquet(ledger)
    findings = spark.read.schema(LEDGER).parquet(ledger).filter((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", "spans").dropDuplicates(["blob"])
    paths = versions.select(F.col(path), F.sha2(content, 256).alias("blob"))
    none = F.array().cast(SPANS)
    return paths.join(findings, "blob", "left").select(F.col(path), "blob", F.coalesce("spans", none).alias("spans"))
