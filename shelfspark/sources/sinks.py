"""Writers: tables from their declared schema, sorted layouts, appended rows, reports as pages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime
from html import escape

from pyspark.sql import DataFrame, SparkSession

from .schemas import SCHEMAS


def create_table(spark: SparkSession, name: str) -> None:
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCHEMAS[name])
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def append(df: DataFrame, name: str) -> None:
    """Rows with the table's own columns and types."""
    df.select(*(df[f.name].cast(f.dataType) for f in SCHEMAS[name])).write.insertInto(name)


def write_sorted(df: DataFrame, path: str, keys: list[str], partitions: int | None = None) -> None:
    """Files in ranges of ``keys`` and sorted within: their statistics stand in for an index."""
    dealt = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


# What stands on the two reports, as (title, filters, columns and their headings, text where there is no row).
OVERDUE = (
    "Relatório de Empréstimos em Atraso",
    "Empréstimos sem devolução há mais de 7 dias",
    {"LVRTITULO": "Livro", "CLINOME": "Cliente", "data_emprestimo": "Data do empréstimo", "dias_atraso": "Dias de atraso"},
    "Nenhum empréstimo em atraso.",
)
MOST_BORROWED = (
    "Relatório de Livros Mais Emprestados",
    "Top 10 livros mais emprestados",
    {"posicao": "#", "LVRTITULO": "Livro", "total_emprestimos": "Quantidade de Empréstimos"},
    "Nenhum empréstimo registrado.",
)


def document(df: DataFrame, report: tuple[str, str, dict[str, str], str], made: datetime) -> Iterator[str]:
    """A report as a whole HTML document, part by part: ``report`` is OVERDUE or MOST_BORROWED."""
    title, filters, headings, empty = report
    yield f'<!DOCTYPE html>\n<html lang="pt-BR">\n<head><meta charset="UTF-8"><title>{escape(title)}</title></head>\n<body>\n'
    yield from html(df, title, headings, empty, [f"Gerado em {made:%d/%m/%Y %H:%M}", f"Filtros: {filters}"])
    yield "</body>\n</html>\n"


def html(df: DataFrame, title: str, headings: dict[str, str], empty: str = "Nenhum registro encontrado.", notes: Sequence[str] = ()) -> Iterator[str]:
    """A heading, ``notes`` below it and a table, part by part: ``headings`` names the columns shown.

    Rows come from one partition at a time, so a long report needs no more memory."""
    yield f"<h1>{escape(title)}</h1>\n{''.join(f'<div>{escape(x)}</div>\n' for x in notes)}<table>\n<tr>{''.join(f'<th>{escape(h)}</th>' for h in headings.values())}</tr>\n"
    n = 0
    for n, row in enumerate(df.select(*headings).toLocalIterator(), 1):
        yield f"<tr>{''.join(f'<td>{escape("" if v is None else str(v))}</td>' for v in row)}</tr>\n"
    if not n:
        yield f"<tr><td colspan={len(headings)}>{escape(empty)}</td></tr>\n"
    yield f"</table>\n<p>Total: {n}</p>\n"
