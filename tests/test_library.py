"""Hand-computed boundaries of the library's rules."""

import datetime as dt
import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import changes, text
from shelfspark.operators import rows
from shelfspark.plans import reports
from shelfspark.sources import tables
from shelfspark.sources.schemas import FOREIGN_KEYS, PRIMARY_KEYS, SCHEMAS, UNIQUE_KEYS

AS_OF = "2026-11-25"


def d(s):
    return dt.date.fromisoformat(s) if s else None


@pytest.fixture(scope="module")
def library(spark):
    books = spark.createDataFrame([(10, "acao"), (11, "Ação"), (12, "Zebra"), (13, "Zebra"), (15, "Nunca")], "LVRCODIGO long, LVRTITULO string")
    clients = spark.createDataFrame([(100, "Ana"), (101, "Bia")], "CLICODIGO long, CLINOME string")
    loans = [
        (1, 10, 1, 100, "2026-11-18", None), (2, 10, 1, 101, "2026-11-17", None), (3, 11, 1, 100, "2026-11-01", None), (4, 11, 1, 101, "2026-10-01", "2026-10-05"),
        (5, 12, 2, 100, "2026-11-20", None), (6, 13, 2, 101, "2026-11-20", "2026-11-22"), (7, 14, 2, 101, "2026-10-01", None),
    ]
    return books, clients, spark.createDataFrame([(*x[:4], d(x[4]), d(x[5])) for x in loans], SCHEMAS["EMPRESTIMOS"])


def test_overdue_starts_on_the_eighth_day(library):
    books, clients, loans = library
    got = [(r.EMPCODIGO, r.LVRTITULO, r.CLINOME, r.dias_atraso, r.data_emprestimo) for r in reports.overdue(loans, books, clients, AS_OF).collect()]
    assert got == [(3, "Ação", "Ana", 17, "01/11/2026"), (2, "acao", "Bia", 1, "17/11/2026")]


def test_most_borrowed_ties_and_collation(library):
    books, _, loans = library
    plain = [(r.posicao, r.LVRCODIGO, r.total_emprestimos) for r in reports.most_borrowed(loans, books).collect()]
    assert plain == [(1, 11, 2), (2, 10, 2), (3, 12, 1), (4, 13, 1)]
    loose = [(r.posicao, r.LVRCODIGO) for r in reports.most_borrowed(loans, books, collation=reports.LOOSE).collect()]
    assert loose == [(1, 10), (2, 11), (3, 12), (4, 13)]


def test_reminders(library, spark):
    _, _, loans = library
    assert [r.EMPCODIGO for r in reports.due_soon(loans, AS_OF).collect()] == [5]
    assert reports.due_soon(loans, AS_OF, sent=spark.createDataFrame([(5,)], "EMPCODIGO long")).isEmpty()


def test_orphans_and_restriction(library):
    books, _, loans = library
    assert [r.EMPCODIGO for r in rows.orphans(loans, "EMPLIVRO", books, "LVRCODIGO").collect()] == [7]
    assert sorted(r.LVRCODIGO for r in rows.restricted(books, "LVRCODIGO", loans, "EMPLIVRO").collect()) == [10, 11, 12, 13]
    left = rows.cascade(loans, "EMPLIVRO", books.filter("LVRCODIGO = 10"), "LVRCODIGO")
    assert sorted(r.EMPCODIGO for r in left.collect()) == [3, 4, 5, 6, 7]


def test_change_lines(spark):
    log = spark.createDataFrame([(1, "editou", '{"n":"A","z":null}', '{"n":"B","q":"2"}'), (2, "criou", None, '{"n":"B"}'), (3, "excluiu", '{"n":"B"}', None)], "AUDCODIGO long, AUDACAO string, AUDANTES string, AUDDEPOIS string")
    got = [(r.AUDCODIGO, r.linha) for r in reports.audit_lines(log).orderBy("AUDCODIGO", "ordem").collect()]
    assert got == [(1, "n: A → B"), (1, "z: — → —"), (1, "q: — → 2"), (2, "n: B"), (3, "n: B")]


def test_audit_page_joins_after_the_cut(spark):
    log = spark.createDataFrame([(i, 1 if i % 2 else None, "criou", "LIVROS", i, None, '{"n":"x"}', dt.datetime(2026, 1, 1, 12, i)) for i in range(45)], SCHEMAS["AUDITORIAS"])
    users = spark.createDataFrame([(1, "Eva")], "id long, name string")
    page = reports.audit_page(log, users, number=3).collect()
    assert [r.AUDCODIGO for r in page] == [4, 3, 2, 1, 0]
    assert [r.usuario for r in page] == ["Sistema", "Eva", "Sistema", "Eva", "Sistema"]
    assert page[0].registro == "LIVROS #4" and page[0].quando == "01/01/2026 12:04"
    assert reports.page_count(log, 20).first() == (45, 3)
    assert reports.page_count(log.limit(0), 20).first() == (0, 0)


def test_pages_by_key(spark):
    log = spark.range(45).selectExpr("id AS AUDCODIGO")
    assert [r[0] for r in reports.page_after(log, "AUDCODIGO", 25, 20).collect()] == list(range(24, 4, -1))
    assert [r[0] for r in reports.page_after(log, "AUDCODIGO", 5, 20).collect()] == [4, 3, 2, 1, 0]


def test_each_image_is_parsed_once(spark):
    log = spark.createDataFrame([(1, "editou", '{"n":"A"}', '{"n":"B"}')], "AUDCODIGO long, AUDACAO string, AUDANTES string, AUDDEPOIS string")
    out = io.StringIO()
    with redirect_stdout(out):
        reports.audit_lines(log).explain()
    assert out.getvalue().count("from_json") == 2


def test_users_of_levels(spark):
    levels = spark.createDataFrame([(1, "a"), (2, "b")], "NVLCODIGO long, NVLNOME string")
    users = spark.createDataFrame([(5, "Eva", 1), (6, "Ivo", 1)], "USRCODIGO long, USRNOME string, USRNIVEL long")
    assert sorted(map(tuple, reports.users_of_levels(users, levels).collect()), key=str) == [(1, "a", 5, "Eva"), (1, "a", 6, "Ivo"), (2, "b", None, None)]


def test_inverted_list(spark):
    a = spark.createDataFrame([(["x", "y", "x"],), ([],), (None,)], "a array<string>")
    assert [r[0] for r in a.select(text.inverted(F.col("a"))).collect()] == [{"x": 2, "y": 1}, {}, None]


def test_snapshot_diff(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d")], "id long, v string")
    got = sorted((r.id, r.acao, r.antes, r.depois) for r in rows.snapshot_diff(old, new, "id").collect())
    assert got == [(2, "editou", {"v": "b"}, {"v": "B"}), (3, "excluiu", {"id": "3", "v": "c"}, None), (4, "criou", None, {"id": "4", "v": "d"})]
    hidden = {r.id: (r.antes, r.depois) for r in rows.snapshot_diff(old.withColumn("senha", F.lit("x")), new.withColumn("senha", F.lit("y")), "id", hidden=("senha",)).collect()}
    assert hidden == {1: ({}, {}), 2: ({"v": "b"}, {"v": "B"}), 3: ({"id": "3", "v": "c"}, None), 4: (None, {"id": "4", "v": "d"})}


def test_lists_and_text(spark):
    assert tables.parse_list(" a@x , ,0,b@y") == ["a@x", "b@y"] and tables.parse_list(None) == []
    row = spark.createDataFrame([(" a@x , ,0,b@y", "São Ç_é", "A@X", "1.2")], "l string, s string, e string, i string").select(
        text.parsed_list(F.col("l")).alias("l"), text.transliterate(F.col("s")).alias("t"), text.slug(F.col("s")).alias("g"), text.attempt_key(F.col("e"), F.col("i")).alias("k"), text.hyphened(F.col("s")).alias("h")
    ).first()
    assert row == (["a@x", "b@y"], "Sao C_e", "sao-c-e", "a@x|1.2", "São Ç-é")


def test_uniqueness(spark):
    t = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None), (5, None)], "id long, k string")
    assert sorted(r.id for r in rows.unique_but_for_self(t, "k", "id").collect()) == [3, 4, 5]
    assert [tuple(r) for r in rows.duplicates(t, ["k"]).collect()] == [("x", 2)]


def test_writes(spark):
    t = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    assert [tuple(r) for r in rows.update(t, F.col("id") == 2, {"v": F.lit("z")}).orderBy("id").collect()] == [(1, "a"), (2, "z")]
    assert [r.id for r in rows.delete(t, F.col("v") == "a").collect()] == [2]
    assert rows.insert(t, spark.createDataFrame([(3,)], "id int"), defaults={"v": F.lit("d")}).filter("id = 3").first() == (3, "d")
    reset = t.select("id", rows.reset_if_changed(F.lit("seen"), F.lit("a"), F.col("v")).alias("s")).orderBy("id")
    assert [tuple(r) for r in reset.collect()] == [(1, "seen"), (2, None)]


def test_validation_and_membership(spark):
    t = spark.createDataFrame([("Ana", "ana@x.org", "password", "password"), (" ", "Ana@x.org", "p", "q"), (None, "nope", None, None)], "n string, e string, p string, c string")
    got = [r[0] for r in t.select(rows.account_errors(*map(F.col, "nepc"))).collect()]
    assert got[0] == [] and got[1] == ["name.required", "email.lowercase", "password.confirmed", "password.min"]
    assert got[2] == ["name.required", "email.email", "password.required"]
    assert t.limit(1).select(rows.account_errors(*map(F.col, "nepc"), taken=F.lit(True))).first()[0] == ["email.unique"]
    keys = spark.createDataFrame([("A@x", None), (None, "1.2")], "e string, i string").select(text.attempt_key(F.col("e"), F.col("i"))).collect()
    assert [r[0] for r in keys] == ["a@x|", "|1.2"]
    members = t.select(rows.member(F.col("e"), ["ana@x.org"]).alias("m"), rows.member(F.col("e"), []).alias("none")).collect()
    assert [r.m for r in members] == [True, False, False] and not any(r.none for r in members)


def test_maps(spark):
    row = spark.range(1).select(
        F.map_keys(changes.without_keys(changes.decoded(F.lit('{"a":1,"senha":"x"}')), ["senha"])).alias("a"),
        F.size(changes.decoded(F.lit(None).cast("string"))).alias("b"),
    ).first()
    assert row == (["a"], 0)


def test_schemas_agree():
    for name, key in PRIMARY_KEYS.items():
        assert set(key) <= set(SCHEMAS[name].names)
    for name, keys in UNIQUE_KEYS.items():
        assert set(keys) <= set(SCHEMAS[name].names)
    for child, a, parent, b, _ in FOREIGN_KEYS:
        assert SCHEMAS[child][a].dataType == SCHEMAS[parent][b].dataType


def test_sources(spark):
    o = tables.jdbc_options("mysql", table="LIVROS", partition=("LVRCODIGO", 1, 100, 4), host="h", port="3306", database="b", user="u")
    assert o["url"] == "jdbc:mysql://h:3306/b" and o["numPartitions"] == "4" and o["user"] == "u"
    assert tables.disk_path("s3", "/a.parquet", bucket="x") == "s3a://x/a.parquet"
    u = tables.made_up_users(spark, 3, AS_OF, email="one@x.org").collect()
    assert len(u) == 3 and u[0].email == "one@x.org" and tables.made_up_users(spark, 1, AS_OF, verified=False).first().email_verified_at is None


def test_plans_are_what_they_should_be(spark):
    from shelfspark.queries import QUERIES

    def plan(name):
        out = io.StringIO()
        with redirect_stdout(out):
            QUERIES[name](spark, "/root/testdata/sf0.001").explain("formatted")
        return out.getvalue()

    top = plan("lim1_top10_most_borrowed")
    assert "TakeOrderedAndProject" in top and "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in top
    assert "TakeOrderedAndProject" in plan("lim2_audit_page")
    late = plan("srt1_overdue_report")
    assert "o_orderdate" in late and "PushedFilters" in late and "BroadcastHashJoin" in late
