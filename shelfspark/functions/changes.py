"""Before and after of a changed record: maps from column to text, and how a change reads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAP = "map<string,string>"

CREATED, EDITED, DELETED = "criou", "editou", "excluiu"

#: What stands for a missing or null value.
NONE = "—"


def decoded(json: Column) -> Column:
    """A JSON object as a map that keeps the order of its keys; null: empty."""
    return F.coalesce(F.from_json(json, MAP), F.create_map().cast(MAP))


def without_keys(m: Column, hidden: list[str]) -> Column:
    return F.map_filter(m, lambda k, v: ~k.isin(hidden)) if hidden else m


def only_keys_of(m: Column, other: Column) -> Column:
    return F.map_filter(m, lambda k, v: F.array_contains(F.map_keys(other), k))


def all_keys(before: Column, after: Column) -> Column:
    """Keys of either, those of ``before`` first, each in its order."""
    return F.array_union(F.map_keys(before), F.map_keys(after))


def change_lines(action: Column, before: Column, after: Column) -> Column:
    """One line a key: "key: old → new", or the one value that a creation or deletion has."""
    shown = lambda m, k: F.coalesce(m[k], F.lit(NONE))

    def line(k: Column) -> Column:
        edited = F.concat(k, F.lit(": "), shown(before, k), F.lit(" → "), shown(after, k))
        return F.when(action == EDITED, edited).when(action == CREATED, F.concat(k, F.lit(": "), shown(after, k))).otherwise(F.concat(k, F.lit(": "), shown(before, k)))

    return F.transform(all_keys(before, after), line)
