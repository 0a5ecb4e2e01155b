"""The reports, as plans over library tables. Dates are relative to an explicit ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.changes import change_lines, decoded
from ..functions.text import day, minute

#: Days that a loan lasts; it is overdue the day after.
TERM_DAYS = 7
LEAD_DAYS = 2
AUDIT_PAGE, GENRE_PAGE = 20, 15

#: Collation that ignores case, accents and trailing spaces; binary order is the default.
LOOSE = "UNICODE_CI_AI_RTRIM"


def _as_of(as_of: str) -> Column:
    return F.to_date(F.lit(as_of))


def most_borrowed(loans: DataFrame, books: DataFrame, k: int = 10, collation: str | None = None) -> DataFrame:
    """The k books with most loans: ordinal, code, title, loans.

    Loans are counted by book code before the join, so each book meets its title
    once; the order is loans, title, code. The ordinal's window sees k rows."""
    counts = loans.groupBy("EMPLIVRO").agg(F.count("EMPCODIGO").alias("total_emprestimos"))
    named = counts.join(books.select("LVRCODIGO", "LVRTITULO"), F.col("EMPLIVRO") == F.col("LVRCODIGO"))
    title = F.collate("LVRTITULO", collation) if collation else F.col("LVRTITULO")
    order = [F.desc("total_emprestimos"), title.asc(), F.asc("LVRCODIGO")]
    top = named.select("LVRCODIGO", "LVRTITULO", "total_emprestimos").orderBy(*order).limit(k)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("posicao"), "LVRCODIGO", "LVRTITULO", "total_emprestimos")


def overdue(loans: DataFrame, books: DataFrame, clients: DataFrame, as_of: str, term_days: int = TERM_DAYS) -> DataFrame:
    """Open loans past their term, oldest first, with title, client and days overdue."""
    late = loans.filter(F.col("EMPDTDEVOL").isNull() & (F.col("EMPDTEMPR") < F.date_sub(_as_of(as_of), term_days)))
    joined = late.join(books.select("LVRCODIGO", "LVRTITULO"), F.col("EMPLIVRO") == F.col("LVRCODIGO")).join(clients.select("CLICODIGO", "CLINOME"), F.col("EMPCLIENTE") == F.col("CLICODIGO"))
    out = joined.select(*(F.col(c) for c in loans.columns), "LVRTITULO", "CLINOME", (F.datediff(_as_of(as_of), "EMPDTEMPR") - term_days).alias("dias_atraso"), day(F.col("EMPDTEMPR")).alias("data_emprestimo"))
    return out.orderBy(F.asc_nulls_first("EMPDTEMPR"), "EMPCODIGO")


def due_soon(loans: DataFrame, as_of: str, sent: DataFrame | None = None, term_days: int = TERM_DAYS, lead_days: int = LEAD_DAYS) -> DataFrame:
    """Open loans that are due in ``lead_days`` and not reminded of (``sent``: EMPCODIGO).

    A loan is due ``term_days`` after its date. The predicate is on the loan's own
    date, so it reaches the reader."""
    due = loans.filter(F.col("EMPDTDEVOL").isNull() & (F.col("EMPDTEMPR") == F.date_add(_as_of(as_of), lead_days - term_days)))
    return due if sent is None else due.join(sent.select("EMPCODIGO").distinct(), "EMPCODIGO", "left_anti")


def due_on(loans: DataFrame, days: DataFrame, term_days: int = TERM_DAYS, lead_days: int = LEAD_DAYS) -> DataFrame:
    """Open loans to remind of on each of ``days`` (dia), with the day."""
    lent = days.select("dia").distinct().withColumn("__lent", F.date_add("dia", lead_days - term_days))
    return loans.filter(F.col("EMPDTDEVOL").isNull()).join(lent, F.col("EMPDTEMPR") == F.col("__lent")).drop("__lent")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page by offset: a top-k of what precedes its end."""
    return df.orderBy(*order).offset(size * (number - 1)).limit(size)


def page_after(df: DataFrame, key: str, last, size: int) -> DataFrame:
    """The page that follows ``last`` in falling order of a unique key. The predicate
    reaches the reader, and no page costs more than the first, however deep it is."""
    return df.filter(F.col(key) < F.lit(last)).orderBy(F.desc(key)).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return total.select("total", F.ceil(F.col("total") / size).cast("long").alias("paginas"))


def audit_page(log: DataFrame, users: DataFrame, number: int = 1, size: int = AUDIT_PAGE) -> DataFrame:
    """A page of the change log, newest first: when, who, what, on which record, and the
    lines of the change. The page is cut before users are joined: at most ``size`` rows."""
    newest = Window.orderBy(F.desc("AUDCODIGO"))
    rows = page(log, [F.desc("AUDCODIGO")], number, size).withColumn("__n", F.row_number().over(newest))
    named = rows.join(users.select(F.col("id").alias("__u"), "name"), F.col("AUDUSUARIO") == F.col("__u"), "left")
    return _decoded_once(named).select(
        "AUDCODIGO",
        minute(F.col("AUDDATA")).alias("quando"),
        F.coalesce("name", F.lit("Sistema")).alias("usuario"),
        "AUDACAO",
        F.concat("AUDTABELA", F.lit(" #"), F.col("AUDREGISTRO")).alias("registro"),
        F.array_join(change_lines(F.col("AUDACAO"), F.col("__antes"), F.col("__depois")), "\n").alias("detalhes"),
        "__n",
    ).orderBy("__n").drop("__n")


def audit_lines(log: DataFrame) -> DataFrame:
    """One row for each line of each change, with its place."""
    maps = _decoded_once(log.select("AUDCODIGO", "AUDACAO", "AUDANTES", "AUDDEPOIS"))
    lines = change_lines(F.col("AUDACAO"), F.col("__antes"), F.col("__depois"))
    return maps.select("AUDCODIGO", F.posexplode(lines).alias("ordem", "linha"))


def _decoded_once(log: DataFrame) -> DataFrame:
    """``log`` with both images as columns: change lines name them for each key, and an
    expression in their place would parse the JSON as often."""
    return log.withColumns({"__antes": decoded(F.col("AUDANTES")), "__depois": decoded(F.col("AUDDEPOIS"))})


def genre_page(genres: DataFrame, number: int = 1, size: int = GENRE_PAGE) -> DataFrame:
    return page(genres, [F.asc_nulls_first("GNRNOME"), F.asc("GNRCODIGO")], number, size)


def level_of_users(users: DataFrame, levels: DataFrame) -> DataFrame:
    """Each user with their level's name, or null."""
    return users.join(levels, F.col("USRNIVEL") == F.col("NVLCODIGO"), "left").select(*users.columns, "NVLNOME")


def users_of_levels(users: DataFrame, levels: DataFrame) -> DataFrame:
    """Each level with its users, a row each, so that a level may have any number; a
    level without any has one row of nulls."""
    return levels.join(users, F.col("NVLCODIGO") == F.col("USRNIVEL"), "left").select(*levels.columns, "USRCODIGO", "USRNOME")


def books_with(books: DataFrame, bridge: DataFrame, book: str, other: str, others: DataFrame, key: str, main: str | None = None) -> DataFrame:
    """Books with their authors or genres, over a bridge table; ``main``: only the main one."""
    pairs = bridge.filter(F.col(main)) if main else bridge
    return books.join(pairs.select(book, other).distinct(), F.col("LVRCODIGO") == F.col(book)).join(others, F.col(other) == F.col(key))


# Rules that the documentation states and no code had: extensions.


def too_young(loans: DataFrame, books: DataFrame, clients: DataFrame) -> DataFrame:
    """Loans of books to clients under the book's age on the day of the loan."""
    joined = loans.join(books.select("LVRCODIGO", "LVRFAIXAETARIA"), F.col("EMPLIVRO") == F.col("LVRCODIGO")).join(clients.select("CLICODIGO", "CLIDTNASC"), F.col("EMPCLIENTE") == F.col("CLICODIGO"))
    age = F.floor(F.months_between("EMPDTEMPR", "CLIDTNASC") / 12)
    return joined.filter(age < F.col("LVRFAIXAETARIA")).select(*loans.columns)


def over_limit(loans: DataFrame, limit: int) -> DataFrame:
    """Clients with more than ``limit`` open loans."""
    return loans.filter(F.col("EMPDTDEVOL").isNull()).groupBy("EMPCLIENTE").agg(F.count(F.lit(1)).alias("abertos")).filter(F.col("abertos") > limit)


def available_copies(copies: DataFrame) -> DataFrame:
    return copies.groupBy("EXMLIVRO").agg(F.count_if("EXMDISPONIVEL").alias("disponiveis"), F.count(F.lit(1)).alias("exemplares"))
