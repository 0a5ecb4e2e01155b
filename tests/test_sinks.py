import datetime as dt

from shelfspark.plans import reports
from shelfspark.sources import sinks, tables
from shelfspark.sources.schemas import SCHEMAS


def test_tables_come_and_go(spark):
    sinks.create_table(spark, "GENEROS")
    sinks.append(spark.createDataFrame([("Poesia", 1)], "GNRNOME string, GNRCODIGO int"), "GENEROS")
    got = spark.table("GENEROS")
    assert [tuple(r) for r in got.collect()] == [(1, "Poesia")] and got.dtypes == [("GNRCODIGO", "bigint"), ("GNRNOME", "string")]
    sinks.drop_table(spark, "GENEROS")
    sinks.drop_table(spark, "GENEROS")
    assert not spark.catalog.tableExists("GENEROS")


def test_sorted_layout_and_typed_reader(spark, tmp_path):
    loans = spark.createDataFrame([(i, i % 7, 1, i % 3, dt.date(2026, 1, 1), None) for i in range(100)], SCHEMAS["EMPRESTIMOS"])
    sinks.write_sorted(loans, str(tmp_path / "EMPRESTIMOS.parquet"), ["EMPCLIENTE", "EMPDTDEVOL"], 3)
    back = tables.table(spark, str(tmp_path), "EMPRESTIMOS")
    assert back.schema == SCHEMAS["EMPRESTIMOS"] and back.count() == 100
    per_file = [{r.EMPCLIENTE for r in spark.read.parquet(f).collect()} for f in back.inputFiles()]
    assert sum(map(len, per_file)) <= 3 + len(per_file) - 1


def test_reports_as_documents(spark):
    made = dt.datetime(2026, 11, 25, 8, 5)
    books = spark.createDataFrame([(1, "Ação")], "LVRCODIGO long, LVRTITULO string")
    clients = spark.createDataFrame([(7, "Ana")], "CLICODIGO long, CLINOME string")
    loans = spark.createDataFrame([(1, 1, 1, 7, dt.date(2026, 11, 1), None)], SCHEMAS["EMPRESTIMOS"])
    late = "".join(sinks.document(reports.overdue(loans, books, clients, "2026-11-25"), sinks.OVERDUE, made))
    assert "<h1>Relatório de Empréstimos em Atraso</h1>" in late and "Gerado em 25/11/2026 08:05" in late and "mais de 7 dias" in late
    assert "<tr><th>Livro</th><th>Cliente</th><th>Data do empréstimo</th><th>Dias de atraso</th></tr>" in late and "<tr><td>Ação</td><td>Ana</td><td>01/11/2026</td><td>17</td></tr>" in late
    top = "".join(sinks.document(reports.most_borrowed(loans, books), sinks.MOST_BORROWED, made))
    assert "<tr><th>#</th><th>Livro</th><th>Quantidade de Empréstimos</th></tr>" in top and "<tr><td>1</td><td>Ação</td><td>1</td></tr>" in top
    assert "Nenhum empréstimo em atraso." in "".join(sinks.document(reports.overdue(loans.limit(0), books, clients, "2026-11-25"), sinks.OVERDUE, made))
    assert "Nenhum empréstimo registrado." in "".join(sinks.document(reports.most_borrowed(loans.limit(0), books), sinks.MOST_BORROWED, made))


def test_jdbc_reads_in_parts(spark, tmp_path, monkeypatch):
    """A read by the JDBC reader, from the one database that the box has a driver of."""
    monkeypatch.setitem(tables.JDBC, "derby", ("org.apache.derby.iapi.jdbc.AutoloadedDriver", "jdbc:derby:{database};create=true"))
    at = {"database": str(tmp_path / "db")}
    driver, url = tables.JDBC["derby"]
    loans = spark.range(100).selectExpr("id AS EMPCODIGO", "id % 7 AS EMPLIVRO")
    loans.coalesce(1).write.format("jdbc").options(driver=driver, url=url.format(**at), dbtable="EMPRESTIMOS").save()
    got = tables.jdbc(spark, "derby", table="EMPRESTIMOS", partition=("EMPCODIGO", 0, 100, 4), **at)
    assert got.rdd.getNumPartitions() == 4 and sorted(tuple(r) for r in got.collect()) == [(i, i % 7) for i in range(100)]


def test_disks(spark, tmp_path):
    where = tables.disk_path("local", "/x/GENEROS.parquet", root=str(tmp_path))
    spark.createDataFrame([(1, "Poesia")], SCHEMAS["GENEROS"]).write.parquet(where)
    assert (tmp_path / "private/x/GENEROS.parquet").is_dir() and tables.table(spark, where.rpartition("/")[0], "GENEROS").first() == (1, "Poesia")


def test_report_page(spark):
    df = spark.createDataFrame([("A&B", 2), (None, 1)], "t string, n int")
    page = "".join(sinks.html(df, "Mais <emprestados>", {"t": "Título", "n": "Total"}))
    assert "Mais &lt;emprestados&gt;" in page and "<td>A&amp;B</td><td>2</td>" in page and "<td></td><td>1</td>" in page and "Total: 2" in page
    assert "Nenhum registro" in "".join(sinks.html(df.limit(0), "x", {"t": "T"}))
