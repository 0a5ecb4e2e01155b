"""Row-level writes as functions of tables, and checks that give out what violates a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_email


def insert(table: DataFrame, rows: DataFrame, columns: list[str] | None = None, defaults: dict[str, Column] | None = None) -> DataFrame:
    """``table`` with ``rows``, of which only ``columns`` (all) are taken; defaults fill nulls."""
    taken = rows.select(*(columns or rows.columns))
    for c, v in (defaults or {}).items():
        taken = taken.withColumn(c, F.coalesce(F.col(c), v) if c in taken.columns else v)
    return table.unionByName(taken.select(*(F.col(c).cast(table.schema[c].dataType) for c in taken.columns)), allowMissingColumns=True)


def update(table: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """New values where the predicate is true; types stay."""
    return table.withColumns({c: F.when(where, v.cast(table.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def delete(table: DataFrame, where: Column) -> DataFrame:
    """Rows for which the predicate is not true."""
    return table.filter(~F.coalesce(where, F.lit(False)))


def changed(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def reset_if_changed(value: Column, old: Column, new: Column) -> Column:
    """Null once ``new`` differs from ``old``."""
    return F.when(changed(old, new), F.lit(None)).otherwise(value)


def cascade(children: DataFrame, column: str, deleted: DataFrame, key: str) -> DataFrame:
    """Children that are left after their parents are deleted."""
    return children.join(deleted.select(F.col(key).alias("__k")).distinct(), F.col(column) == F.col("__k"), "left_anti")


def restricted(deleted: DataFrame, key: str, children: DataFrame, column: str) -> DataFrame:
    """Deletions that children forbid."""
    return deleted.join(children.select(F.col(column).alias("__k")), F.col(key) == F.col("__k"), "left_semi")


def orphans(children: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is not there; a null reference is none."""
    return children.filter(F.col(column).isNotNull()).join(parents.select(F.col(key).alias("__k")), F.col(column) == F.col("__k"), "left_anti")


def duplicates(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once, with ``n``; keys with a null are exempt."""
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    return table.filter(whole).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def unused(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows whose key the table doesn't hold."""
    return rows.join(table.select(F.col(key).alias("__k")), F.col(key) == F.col("__k"), "left_anti")


def unique_but_for_self(table: DataFrame, key: str, pk: str) -> DataFrame:
    """Rows whose key no other row holds.

    Two rows with a key are enough to know, so this is a count per key and not a
    join of the key's rows with each other."""
    held = table.groupBy(F.col(key).alias("__k")).agg(F.min(pk).alias("__lo"), F.max(pk).alias("__hi"))
    shared = held.filter("__lo != __hi").select("__k")
    return table.join(shared, F.col(key) == F.col("__k"), "left_anti")


def member(column: Column, allowed: list[str]) -> Column:
    """Exact membership; an empty list has no member, and null is none."""
    return F.coalesce(column.isin(allowed), F.lit(False)) if allowed else F.lit(False)


def required(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c) != "")


def lowercase(c: Column) -> Column:
    return c == F.lower(c)


def at_most(c: Column, n: int) -> Column:
    return F.length(c) <= n


def account_errors(name: Column, email: Column, password: Column, confirmation: Column, taken: Column | None = None, least: int = 8) -> Column:
    """Rules that a registration breaks, in order. A field that is missing breaks only
    that rule; ``taken`` is true for an e-mail that another account has; a password
    has at least ``least`` characters."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    fields = [
        ("name", name, [("max", at_most(name, 255))]),
        ("email", email, [("lowercase", lowercase(email)), ("email", is_email(email)), ("max", at_most(email, 255)), ("unique", ~ok(taken if taken is not None else F.lit(False)))]),
        ("password", password, [("confirmed", password.eqNullSafe(confirmation)), ("min", F.length(password) >= least)]),
    ]
    broken = []
    for field, value, rules in fields:
        there = ok(required(value))
        broken.append(F.when(~there, F.lit(f"{field}.required")))
        broken += [F.when(there & ~ok(c), F.lit(f"{field}.{n}")) for n, c in rules]
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def visible(df: DataFrame, hidden: list[str]) -> DataFrame:
    return df.drop(*hidden)


def snapshot_diff(old: DataFrame, new: DataFrame, pk: str, hidden: tuple[str, ...] = ()) -> DataFrame:
    """(pk, acao, antes, depois) between two snapshots: what was created, edited or
    deleted. An edit holds the columns that changed, as maps to text; the others hold
    the whole row with its key. No image holds a ``hidden`` column."""
    columns = [c for c in old.columns if c != pk]
    shown = [c for c in (pk, *columns) if c not in hidden]
    as_map = lambda side: F.create_map(*(x for c in shown for x in (F.lit(c), F.col(f"{side}.{c}").cast("string"))))
    o = old.withColumn("__there", F.lit(True)).alias("o")
    n = new.withColumn("__there", F.lit(True)).alias("n")
    both = o.join(n, F.col(f"o.{pk}") == F.col(f"n.{pk}"), "full")
    gone, came = F.col("n.__there").isNull(), F.col("o.__there").isNull()
    dirty = reduce(lambda a, b: a | b, (changed(F.col(f"o.{c}"), F.col(f"n.{c}")) for c in columns))
    keys = F.filter(F.array(*(F.when(gone | came | changed(F.col(f"o.{c}"), F.col(f"n.{c}")), F.lit(c)) for c in shown)), lambda x: x.isNotNull())
    some = lambda side, none: F.when(~none, F.map_filter(as_map(side), lambda k, v: F.array_contains(keys, k)))
    return both.filter(gone | came | dirty).select(
        F.coalesce(f"o.{pk}", f"n.{pk}").alias(pk),
        F.when(came, "criou").when(gone, "excluiu").otherwise("editou").alias("acao"),
        some("o", came).alias("antes"),
        some("n", gone).alias("depois"),
    )
