"""String functions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and the ASCII letter of each.
MARKED = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿ"
PLAIN = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOoooooUUUUuuuuYyy"


def transliterate(s: Column) -> Column:
    """ASCII form of Latin text."""
    return F.translate(s, MARKED, PLAIN)


def slug(s: Column) -> Column:
    plain = F.regexp_replace(F.lower(transliterate(s)), "[^a-z0-9]+", "-")
    return F.regexp_replace(plain, "^-+|-+$", "")


def hyphened(s: Column) -> Column:
    return F.replace(s, F.lit("_"), F.lit("-"))


def attempt_key(email: Column, ip: Column) -> Column:
    """What attempts are counted by: both parts; a null one is empty, so that the other still tells attempts apart."""
    return transliterate(F.concat(F.lower(F.coalesce(email, F.lit(""))), F.lit("|"), F.coalesce(ip, F.lit(""))))


def parsed_list(s: Column) -> Column:
    """Comma-separated entries: trimmed, without empty ones and "0"."""
    return F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: (x != "") & (x != "0"))


def inverted(a: Column) -> Column:
    """Entries of a list as keys, each with its last place (from 0)."""
    keys = F.array_distinct(a)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: (F.size(a) - F.array_position(F.reverse(a), k)).cast("int")))


def is_email(s: Column) -> Column:
    return F.rlike(s, F.lit(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"))


def day(d: Column) -> Column:
    return F.date_format(d, "dd/MM/yyyy")


def minute(t: Column) -> Column:
    return F.date_format(t, "dd/MM/yyyy HH:mm")
