"""Registered queries over the driver's tables and the same results as DuckDB SQL.

A key starts with the identifier, in the survey, of the operation that it shows first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import changes, text
from .operators import rows
from .plans import reports
from .sources import analog, tables
from .sources.analog import AS_OF, read
from .streaming import attempts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_LOANS = """(SELECT l_orderkey * 10 + l_linenumber AS "EMPCODIGO", l_partkey AS "EMPLIVRO", l_suppkey AS "EMPUSUARIO", o_custkey AS "EMPCLIENTE",
 o_orderdate::DATE AS "EMPDTEMPR", CASE WHEN l_returnflag <> 'N' THEN l_shipdate::DATE END AS "EMPDTDEVOL" FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_ACTION = "CASE event_type WHEN 'signup' THEN 'criou' WHEN 'error' THEN 'excluiu' ELSE 'editou' END"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


# Scans and lookups


@query("src1_loan_scan", """SELECT l_orderkey AS "EMPCODIGO", l_partkey AS "EMPLIVRO" FROM lineitem""")
def src1(spark, sf):
    return analog.loans_of_books(spark, sf)


@query("src2_genre_scan", """SELECT n_nationkey::BIGINT AS "GNRCODIGO", n_name AS "GNRNOME" FROM nation""")
def src2(spark, sf):
    return analog.genres(spark, sf)


@query("src3_audit_scan", f"""SELECT event_id AS "AUDCODIGO", user_id AS "AUDUSUARIO", {_ACTION} AS "AUDACAO", CASE WHEN event_type <> 'signup' THEN props END AS "AUDANTES" FROM events""")
def src3(spark, sf):
    return analog.audit_log(spark, sf).select("AUDCODIGO", "AUDUSUARIO", "AUDACAO", "AUDANTES")


@query("src5_point_lookup", "SELECT * FROM nation WHERE n_nationkey = 7")
def src5(spark, sf):
    return tables.by_key(read(spark, sf, "nation"), "n_nationkey", 7)


@query("src6_key_and_hash_lookup", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey = 1 AND sha1(s_name) = sha1('Supplier#000000001')")
def src6(spark, sf):
    import hashlib

    return tables.by_key_and_hash(read(spark, sf, "supplier"), "s_suppkey", 1, "s_name", hashlib.sha1(b"Supplier#000000001").hexdigest()).select("s_suppkey", "s_name")


@query("src7_unique_key_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000003' LIMIT 1")
def src7(spark, sf):
    return tables.by_unique_key(read(spark, sf, "customer"), "c_name", "Customer#000000003").select("c_custkey", "c_name")


@query("src11_made_up_users", "SELECT i AS id, 'User ' || i AS name, 'user' || i || '@example.org' AS email, sha256('password' || i) AS password, substr(sha1(i::VARCHAR), 1, 10) AS remember_token FROM range(1, 101) t(i)")
def src11(spark, sf):
    return tables.made_up_users(spark, 100, AS_OF).select("id", "name", "email", "password", "remember_token")


@query("src12_unverified_users", f"SELECT i AS id, 'Test User' AS name, NULL AS verificado FROM range(1, 11) t(i) UNION ALL SELECT i, 'User ' || i, '{AS_OF}' FROM range(1, 6) t(i)")
def src12(spark, sf):
    unverified = tables.made_up_users(spark, 10, AS_OF, verified=False, name="Test User")
    return unverified.unionAll(tables.made_up_users(spark, 5, AS_OF)).select("id", "name", F.date_format("email_verified_at", "yyyy-MM-dd").alias("verificado"))


# Reports


@query(
    "lim1_top10_most_borrowed",
    """SELECT row_number() OVER (ORDER BY n DESC, p_name, p_partkey)::INTEGER AS posicao, p_partkey AS "LVRCODIGO", p_name AS "LVRTITULO", n AS total_emprestimos
FROM (SELECT p_partkey, p_name, count(l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey, p_name ORDER BY n DESC, p_name, p_partkey LIMIT 10)""",
)
def most_borrowed(spark, sf):
    return reports.most_borrowed(analog.loans_of_books(spark, sf), analog.books(spark, sf))


@query(
    "agg1_loans_per_book",
    """SELECT p_partkey AS "LVRCODIGO", p_name AS "LVRTITULO", count(l_orderkey) AS total_emprestimos FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey, p_name""",
)
def loans_per_book(spark, sf):
    counts = analog.loans_of_books(spark, sf).groupBy("EMPLIVRO").agg(F.count("EMPCODIGO").alias("total_emprestimos"))
    return counts.join(analog.books(spark, sf), F.col("EMPLIVRO") == F.col("LVRCODIGO")).select("LVRCODIGO", "LVRTITULO", "total_emprestimos")


@query(
    "srt1_overdue_report",
    f"""SELECT e.*, p_name AS "LVRTITULO", c_name AS "CLINOME", (date_diff('day', e."EMPDTEMPR", DATE '{AS_OF}') - 7)::INTEGER AS dias_atraso, strftime(e."EMPDTEMPR", '%d/%m/%Y') AS data_emprestimo
FROM {_LOANS} e JOIN part ON "EMPLIVRO" = p_partkey JOIN customer ON "EMPCLIENTE" = c_custkey
WHERE "EMPDTDEVOL" IS NULL AND "EMPDTEMPR" < DATE '{AS_OF}' - INTERVAL 7 DAY ORDER BY "EMPDTEMPR" NULLS FIRST, "EMPCODIGO" """,
)
def overdue(spark, sf):
    return reports.overdue(analog.loans(spark, sf), analog.books(spark, sf), analog.clients(spark, sf), AS_OF)


@query("flt4_due_reminders", f"""SELECT * FROM {_LOANS} WHERE "EMPDTDEVOL" IS NULL AND "EMPDTEMPR" = DATE '{AS_OF}' - INTERVAL 5 DAY""")
def due_soon(spark, sf):
    return reports.due_soon(analog.loans(spark, sf), AS_OF)


@query(
    "st6_reminders_not_sent",
    f"""SELECT * FROM {_LOANS} e WHERE "EMPDTDEVOL" IS NULL AND "EMPDTEMPR" = DATE '{AS_OF}' - INTERVAL 5 DAY
AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_discount >= 0.05 AND l.l_orderkey * 10 + l.l_linenumber = e."EMPCODIGO")""",
)
def not_sent(spark, sf):
    sent = read(spark, sf, "lineitem").filter("l_discount >= 0.05").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("EMPCODIGO"))
    return reports.due_soon(analog.loans(spark, sf), AS_OF, sent)


@query(
    "jn6_reminder_recipients",
    f"""SELECT "EMPCODIGO", s_name AS name FROM {_LOANS} JOIN supplier ON "EMPUSUARIO" = s_suppkey WHERE "EMPDTDEVOL" IS NULL AND "EMPDTEMPR" = DATE '{AS_OF}' - INTERVAL 5 DAY""",
)
def recipients(spark, sf):
    due = reports.due_soon(analog.loans(spark, sf), AS_OF)
    users = analog.actors(spark, sf)
    return due.join(users, due["EMPUSUARIO"] == users["id"], "left").filter("name IS NOT NULL").select("EMPCODIGO", "name")


_BEFORE_K = "CASE WHEN event_type <> 'signup' THEN json_extract_string(props, '$.k') END"
_AUDIT_LINES = f"""
SELECT event_id, 0 AS ordem, CASE {_ACTION} WHEN 'editou' THEN 'k: ' || {_BEFORE_K} || ' → ' || event_type WHEN 'criou' THEN 'u: ' || user_id ELSE 'k: ' || {_BEFORE_K} END AS linha, user_id, ts, event_type FROM events
UNION ALL SELECT event_id, 1, CASE event_type WHEN 'signup' THEN 'k: ' || event_type ELSE 'u: — → ' || user_id END, user_id, ts, event_type FROM events WHERE event_type <> 'error'"""


@query("fn12_audit_change_lines", f"""SELECT event_id AS "AUDCODIGO", ordem::INTEGER AS ordem, linha FROM ({_AUDIT_LINES})""")
def audit_lines(spark, sf):
    return reports.audit_lines(analog.audit_log(spark, sf))


@query(
    "lim2_audit_page",
    f"""SELECT event_id AS "AUDCODIGO", strftime(any_value(ts), '%d/%m/%Y %H:%M') AS quando, coalesce(any_value(s_name), 'Sistema') AS usuario, any_value({_ACTION}) AS "AUDACAO",
 'events #' || event_id AS registro, string_agg(linha, chr(10) ORDER BY ordem) AS detalhes
FROM ({_AUDIT_LINES}) LEFT JOIN supplier ON user_id = s_suppkey GROUP BY event_id ORDER BY event_id DESC LIMIT 20 OFFSET 20""",
)
def audit_page(spark, sf):
    return reports.audit_page(analog.audit_log(spark, sf), analog.actors(spark, sf), number=2)


@query("lim3_audit_page_after_key", f"""SELECT event_id AS "AUDCODIGO", {_ACTION} AS "AUDACAO" FROM events WHERE event_id < 500 ORDER BY event_id DESC LIMIT 20""")
def page_after_key(spark, sf):
    return reports.page_after(analog.audit_log(spark, sf), "AUDCODIGO", 500, reports.AUDIT_PAGE).select("AUDCODIGO", "AUDACAO")


@query("agg2_audit_page_count", "SELECT count(*) AS total, ceil(count(*) / 20.0)::BIGINT AS paginas FROM events")
def audit_pages(spark, sf):
    return reports.page_count(analog.audit_log(spark, sf), reports.AUDIT_PAGE)


@query("agg3_report_is_empty", f"""SELECT count(*) = 0 AS vazio FROM {_LOANS} WHERE "EMPDTDEVOL" IS NULL AND "EMPDTEMPR" < DATE '{AS_OF}' - INTERVAL 7 DAY""")
def report_is_empty(spark, sf):
    late = reports.overdue(analog.loans(spark, sf), analog.books(spark, sf), analog.clients(spark, sf), AS_OF)
    return late.limit(1).agg((F.count(F.lit(1)) == 0).alias("vazio"))


@query("srt4_genre_page", """SELECT n_nationkey::BIGINT AS "GNRCODIGO", n_name AS "GNRNOME" FROM nation ORDER BY n_name NULLS FIRST, n_nationkey LIMIT 15""")
def genre_page(spark, sf):
    return reports.genre_page(analog.genres(spark, sf))


@query("lim3_genre_page_2", """SELECT n_nationkey::BIGINT AS "GNRCODIGO", n_name AS "GNRNOME" FROM nation ORDER BY n_name NULLS FIRST, n_nationkey LIMIT 15 OFFSET 15""")
def genre_page_2(spark, sf):
    return reports.genre_page(analog.genres(spark, sf), number=2)


# Joins and relations


@query("jn3_change_actor", """SELECT event_id AS "AUDCODIGO", coalesce(s_name, 'Sistema') AS usuario FROM events LEFT JOIN supplier ON user_id = s_suppkey""")
def change_actor(spark, sf):
    log, users = analog.audit_log(spark, sf), analog.actors(spark, sf)
    return log.join(users, log["AUDUSUARIO"] == users["id"], "left").select("AUDCODIGO", F.coalesce("name", F.lit("Sistema")).alias("usuario"))


@query("jn4_users_of_levels", """SELECT r_regionkey::BIGINT AS "NVLCODIGO", r_name AS "NVLNOME", n_nationkey::BIGINT AS "USRCODIGO", n_name AS "USRNOME" FROM region LEFT JOIN nation ON r_regionkey = n_regionkey AND n_nationkey > 4""")
def users_of_levels(spark, sf):
    return reports.users_of_levels(analog.staff(spark, sf).filter("USRCODIGO > 4"), analog.levels(spark, sf))


@query("jn5_level_of_users", """SELECT n_nationkey::BIGINT AS "USRCODIGO", n_name AS "USRNOME", n_regionkey::BIGINT AS "USRNIVEL", r_name AS "NVLNOME" FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""")
def level_of_users(spark, sf):
    return reports.level_of_users(analog.staff(spark, sf), analog.levels(spark, sf))


@query("jn7_books_with_authors", """SELECT DISTINCT p_partkey AS "LVRCODIGO", p_name AS "LVRTITULO", s_suppkey AS "AUTCODIGO", s_name AS "AUTNOME" FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON l_suppkey = s_suppkey""")
def books_with_authors(spark, sf):
    bridge = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("ATRLIVRO"), F.col("l_suppkey").alias("ATRAUTOR"))
    authors = analog.actors(spark, sf).select(F.col("id").alias("AUTCODIGO"), F.col("name").alias("AUTNOME"))
    return reports.books_with(analog.books(spark, sf), bridge, "ATRLIVRO", "ATRAUTOR", authors, "AUTCODIGO").select("LVRCODIGO", "LVRTITULO", "AUTCODIGO", "AUTNOME")


# Writes and constraints


@query("snk4_insert", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT r_regionkey + 100, r_name, 0 FROM region")
def insert(spark, sf):
    new = read(spark, sf, "region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name"))
    return rows.insert(read(spark, sf, "nation"), new, defaults={"n_regionkey": F.lit(0)})


@query("snk5_update_by_key", "SELECT s_suppkey, CASE WHEN s_suppkey = 7 THEN 'renamed' ELSE s_name END AS s_name, s_nationkey, s_acctbal FROM supplier")
def update(spark, sf):
    return rows.update(read(spark, sf, "supplier"), F.col("s_suppkey") == 7, {"s_name": F.lit("renamed")})


@query("snk6_delete_by_key", "SELECT * FROM supplier WHERE s_suppkey <> 7")
def delete(spark, sf):
    return rows.delete(read(spark, sf, "supplier"), F.col("s_suppkey") == 7)


@query("snk7_reset_on_change", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_orderdate END AS verified_at FROM orders")
def reset_on_change(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", rows.reset_if_changed(F.col("o_orderdate"), F.lit("O"), F.col("o_orderstatus")).alias("verified_at"))


@query("snk8_cascade_delete", "SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade(spark, sf):
    gone = read(spark, sf, "customer").filter("c_acctbal < 0")
    return rows.cascade(read(spark, sf, "orders"), "o_custkey", gone, "c_custkey")


@query("snk9_restricted_deletes", "SELECT * FROM customer WHERE c_acctbal < 0 AND c_custkey IN (SELECT o_custkey FROM orders)")
def restricted(spark, sf):
    return rows.restricted(read(spark, sf, "customer").filter("c_acctbal < 0"), "c_custkey", read(spark, sf, "orders"), "o_custkey")


@query("snk9_orphan_users", "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)")
def orphan_users(spark, sf):
    return rows.orphans(read(spark, sf, "events").select("event_id", "user_id"), "user_id", read(spark, sf, "supplier"), "s_suppkey")


@query("snk10_duplicate_names", "SELECT p_name, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY p_name HAVING count(*) > 1")
def duplicate_names(spark, sf):
    return rows.duplicates(read(spark, sf, "part"), ["p_name"])


@query("snk11_duplicate_pairs", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_pairs(spark, sf):
    return rows.duplicates(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("snk14_reminder_messages", f"""SELECT s_name AS para, 'EMPCODIGO ' || "EMPCODIGO" || ': ' || strftime("EMPDTEMPR" + INTERVAL 7 DAY, '%d/%m/%Y') AS mensagem FROM {_LOANS} JOIN supplier ON "EMPUSUARIO" = s_suppkey WHERE "EMPDTDEVOL" IS NULL AND "EMPDTEMPR" = DATE '{AS_OF}' - INTERVAL 5 DAY""")
def messages(spark, sf):
    due, users = reports.due_soon(analog.loans(spark, sf), AS_OF), analog.actors(spark, sf)
    return due.join(users, due["EMPUSUARIO"] == users["id"]).select(F.col("name").alias("para"), F.concat(F.lit("EMPCODIGO "), "EMPCODIGO", F.lit(": "), text.day(F.date_add("EMPDTEMPR", reports.TERM_DAYS))).alias("mensagem"))


@query("snk15_defaults", "SELECT event_id, coalesce(CASE WHEN value > 10 THEN false END, true) AS disponivel FROM events")
def defaults(spark, sf):
    new = read(spark, sf, "events").select("event_id", F.when(F.col("value") > 10, False).alias("disponivel"))
    return rows.insert(new.limit(0), new, defaults={"disponivel": F.lit(True)})


# Predicates


@query("flt7_membership", "SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS permitido FROM customer")
def membership(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", rows.member(F.col("c_mktsegment"), tables.parse_list(" BUILDING, ,0,MACHINERY")).alias("permitido"))


@query("flt8_unused_names", "SELECT c_custkey, c_name FROM customer WHERE c_name NOT IN (SELECT 'Customer' || substr(s_name, 9) FROM supplier)")
def unused_names(spark, sf):
    held = read(spark, sf, "supplier").select(F.concat(F.lit("Customer"), F.substring("s_name", 9, 99)).alias("c_name"))
    return rows.unused(read(spark, sf, "customer").select("c_custkey", "c_name"), held, "c_name")


@query("flt9_unique_ignoring_self", "WITH p AS (SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_size AS nome FROM part) SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE a.nome = b.nome AND a.p_partkey <> b.p_partkey)")
def unique_ignoring_self(spark, sf):
    return rows.unique_but_for_self(read(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_size").alias("nome")), "nome", "p_partkey")


_FORMS = """(SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS n, CASE c_custkey % 5 WHEN 0 THEN lower(c_mktsegment) || '@x.org' WHEN 1 THEN '  ' ELSE c_mktsegment END AS e,
 substr(c_name, 1, CAST(c_custkey % 12 AS INTEGER)) AS p, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE substr(c_name, 1, CAST(c_custkey % 12 AS INTEGER)) END AS c, c_custkey % 10 = 0 AS taken FROM customer)"""


@query(
    "flt10_row_validation",
    f"""SELECT c_custkey, array_to_string(list_filter([CASE WHEN n IS NULL THEN 'name.required' END, CASE WHEN trim(e) = '' THEN 'email.required' END,
 CASE WHEN trim(e) <> '' AND e <> lower(e) THEN 'email.lowercase' END, CASE WHEN trim(e) <> '' AND e NOT LIKE '%@%.%' THEN 'email.email' END, CASE WHEN trim(e) <> '' AND taken THEN 'email.unique' END,
 CASE WHEN p = '' THEN 'password.required' END, CASE WHEN p <> '' AND p <> c THEN 'password.confirmed' END, CASE WHEN p <> '' AND length(p) < 8 THEN 'password.min' END], lambda x: x IS NOT NULL), ',') AS erros FROM {_FORMS}""",
)
def row_validation(spark, sf):
    key = F.col("c_custkey")
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    email = F.when(key % 5 == 0, F.concat(F.lower(segment), F.lit("@x.org"))).when(key % 5 == 1, F.lit("  ")).otherwise(segment)
    password = F.substring(name, F.lit(1), (key % 12).cast("int"))
    errors = rows.account_errors(F.when(key % 7 != 0, name), email, password, F.when(key % 3 == 0, name).otherwise(password), key % 10 == 0)
    return read(spark, sf, "customer").select("c_custkey", F.array_join(errors, ",").alias("erros"))


_TERMS = {"reenvio": attempts.RESEND_SECONDS, "token": attempts.TOKEN_MINUTES * 60, "sessao": attempts.SESSION_MINUTES * 60, "senha": attempts.CONFIRMED_SECONDS}


@query("flt12_live_terms", f"""SELECT event_id, {", ".join(f"event_id % 200 * 60 <= {s} AS {t}" for t, s in _TERMS.items())} FROM events""")
def live_terms(spark, sf):
    minutes = (F.col("event_id") % 200).cast("int")  # the age of each, so that every term ends on some event
    now = F.col("ts") + F.make_dt_interval(mins=minutes)
    return read(spark, sf, "events").select("event_id", *(attempts.live(F.col("ts"), now, s).alias(t) for t, s in _TERMS.items()))


@query("flt13_verified", """SELECT "EMPCODIGO", "EMPDTDEVOL" IS NOT NULL AS devolvido FROM """ + _LOANS)
def verified(spark, sf):
    return analog.loans(spark, sf).select("EMPCODIGO", F.col("EMPDTDEVOL").isNotNull().alias("devolvido"))


@query("flt14_dirty_rows", "SELECT l_orderkey, l_linenumber, l_returnflag IS DISTINCT FROM l_linestatus AS mudou FROM lineitem")
def dirty_rows(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", rows.changed(F.col("l_returnflag"), F.col("l_linestatus")).alias("mudou"))


# Maps, text, dates


@query("prj4_hidden_keys", f"SELECT event_id, CASE {_ACTION} WHEN 'excluiu' THEN '' ELSE 'u' END AS visivel FROM events")
def hidden_keys(spark, sf):
    shown = changes.without_keys(changes.decoded(F.col("AUDDEPOIS")), ["k"])
    return analog.audit_log(spark, sf).select(F.col("AUDCODIGO").alias("event_id"), F.array_join(F.map_keys(shown), ",").alias("visivel"))


@query("set1_key_union", f"SELECT event_id, CASE {_ACTION} WHEN 'editou' THEN 'k,u' WHEN 'criou' THEN 'u,k' ELSE 'k' END AS chaves FROM events")
def key_union(spark, sf):
    before, after = changes.decoded(F.col("AUDANTES")), changes.decoded(F.col("AUDDEPOIS"))
    return analog.audit_log(spark, sf).select(F.col("AUDCODIGO").alias("event_id"), F.array_join(changes.all_keys(before, after), ",").alias("chaves"))


@query("set3_key_intersection", f"SELECT event_id, CASE {_ACTION} WHEN 'editou' THEN 'k' ELSE '' END AS comuns FROM events")
def key_intersection(spark, sf):
    before, after = changes.decoded(F.col("AUDANTES")), changes.decoded(F.col("AUDDEPOIS"))
    return analog.audit_log(spark, sf).select(F.col("AUDCODIGO").alias("event_id"), F.array_join(F.map_keys(changes.only_keys_of(before, after)), ",").alias("comuns"))


@query("fn3_list_parsing", "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(' ' || p_name || ', ,0,' || p_brand, ','), lambda x: trim(x)), lambda x: x <> '' AND x <> '0'), '|') AS lista FROM part")
def list_parsing(spark, sf):
    joined = F.concat(F.lit(" "), "p_name", F.lit(", ,0,"), "p_brand")
    return read(spark, sf, "part").select("p_partkey", F.array_join(text.parsed_list(joined), "|").alias("lista"))


@query("fn_text", "SELECT p_partkey, lower(p_brand) AS minusculas, strip_accents('Ação ' || p_name) AS ascii, lower(p_type) || '|' || p_brand AS chave, replace('a_b', '_', '-') AS hifen, trim(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, sha1(p_name) AS sha1 FROM part")
def text_functions(spark, sf):
    return read(spark, sf, "part").select(
        "p_partkey", F.lower("p_brand").alias("minusculas"), text.transliterate(F.concat(F.lit("Ação "), "p_name")).alias("ascii"), F.concat_ws("|", F.lower("p_type"), "p_brand").alias("chave"),
        text.hyphened(F.lit("a_b")).alias("hifen"), text.slug(F.concat("p_brand", F.lit(" "), "p_name")).alias("slug"), F.sha1("p_name").alias("sha1"),
    )


@query(
    "fn_dates",
    f"SELECT o_orderkey, (o_orderdate::DATE - INTERVAL 7 DAY)::DATE AS antes, (o_orderdate::DATE + INTERVAL 2 DAY)::DATE AS depois, date_diff('day', o_orderdate::DATE, DATE '{AS_OF}')::INTEGER AS dias, strftime(o_orderdate, '%d/%m/%Y') AS dia, strftime(o_orderdate, '%d/%m/%Y %H:%M') AS minuto, ceil(o_totalprice / 60)::BIGINT AS minutos, o_totalprice::BIGINT::VARCHAR::BIGINT AS inteiro FROM orders",
)
def date_functions(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return read(spark, sf, "orders").select(
        "o_orderkey", F.date_sub(d, 7).alias("antes"), F.date_add(d, 2).alias("depois"), F.datediff(F.lit(AS_OF).cast("date"), d).alias("dias"), text.day(d).alias("dia"),
        text.minute(F.col("o_orderdate")).alias("minuto"), F.ceil(F.col("o_totalprice") / 60).alias("minutos"), F.bround("o_totalprice", 0).cast("long").alias("inteiro"),
    )


@query("prj1_star_and_more", f"""SELECT e.*, p_name AS "LVRTITULO", c_name AS "CLINOME" FROM {_LOANS} e JOIN part ON "EMPLIVRO" = p_partkey JOIN customer ON "EMPCLIENTE" = c_custkey""")
def star_and_more(spark, sf):
    e, l, c = analog.loans(spark, sf), analog.books(spark, sf), analog.clients(spark, sf)
    return e.join(l, e["EMPLIVRO"] == l["LVRCODIGO"]).join(c, e["EMPCLIENTE"] == c["CLICODIGO"]).select(*(e[x] for x in e.columns), "LVRTITULO", "CLINOME")


@query("prj3_allowed_columns", "SELECT c_custkey, c_name FROM customer")
def allowed_columns(spark, sf):
    allowed = ["c_custkey", "c_name", "c_password"]
    customer = read(spark, sf, "customer")
    return customer.select(*(c for c in allowed if c in customer.columns))


@query("prj7_casts", "SELECT event_id, ts::DATE::VARCHAR AS dia, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(value AS BIGINT) IS NOT NULL AS tem FROM events")
def casts(spark, sf):
    return read(spark, sf, "events").select("event_id", F.to_date("ts").cast("string").alias("dia"), changes.decoded(F.col("props"))["k"].cast("int").alias("k"), F.col("value").cast("long").isNotNull().alias("tem"))


@query("flt5_not_flagged", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_returnflag = 'N')")
def not_flagged(spark, sf):
    return read(spark, sf, "lineitem").withColumn("enviado", F.col("l_returnflag") == "N").filter(~F.col("enviado")).select("l_orderkey", "l_linenumber")


@query("flt11_confirmed", "SELECT l_orderkey, l_linenumber, l_discount IS NOT DISTINCT FROM l_tax AS confirmado FROM lineitem")
def confirmed(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").eqNullSafe(F.col("l_tax")).alias("confirmado"))


@query("agg4_attempt_counter", "SELECT user_id AS chave, count(*) AS tentativas FROM events WHERE event_type = 'error' GROUP BY user_id")
def attempt_counter(spark, sf):
    return read(spark, sf, "events").filter("event_type = 'error'").groupBy(F.col("user_id").alias("chave")).agg(F.count(F.lit(1)).alias("tentativas"))


@query("srt3_latest_changes", """SELECT event_id AS "AUDCODIGO" FROM events ORDER BY event_id DESC LIMIT 20""")
def latest_changes(spark, sf):
    return reports.page(analog.audit_log(spark, sf).select("AUDCODIGO"), [F.desc("AUDCODIGO")], 1, reports.AUDIT_PAGE)


@query("set2_key_difference", f"SELECT event_id, CASE {_ACTION} WHEN 'excluiu' THEN '' WHEN 'criou' THEN 'u,k' ELSE 'u' END AS novas FROM events")
def key_difference(spark, sf):
    before, after = changes.decoded(F.col("AUDANTES")), changes.decoded(F.col("AUDDEPOIS"))
    return analog.audit_log(spark, sf).select(F.col("AUDCODIGO").alias("event_id"), F.array_join(F.array_except(F.map_keys(after), F.map_keys(before)), ",").alias("novas"))


@query(
    "set4_inverted_list",
    """SELECT p_partkey, array_to_string(list_sort(list_transform(list_distinct(l), lambda x: x || '=' || (len(l) - list_position(list_reverse(l), x)))), ',') AS lugares
FROM (SELECT p_partkey, string_split(p_name || ' ' || p_type || ' ' || split_part(p_name, ' ', 1), ' ') AS l FROM part)""",
)
def inverted_list(spark, sf):
    words = F.split(F.concat_ws(" ", "p_name", "p_type", F.split_part("p_name", F.lit(" "), F.lit(1))), " ")
    places = F.transform(F.map_entries(text.inverted(words)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return read(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(places), ",").alias("lugares"))


@query("fn14_fallbacks", f"SELECT event_id, coalesce(CASE WHEN {_ACTION} <> 'criou' THEN json_extract_string(props, '$.k') END, '—') AS antes FROM events")
def fallbacks(spark, sf):
    return analog.audit_log(spark, sf).select(F.col("AUDCODIGO").alias("event_id"), F.coalesce(changes.decoded(F.col("AUDANTES"))["k"], F.lit(changes.NONE)).alias("antes"))


@query("fn15_conditional", "SELECT event_id, CASE event_type WHEN 'signup' THEN 'criou' WHEN 'error' THEN 'excluiu' ELSE 'editou' END AS acao, CASE WHEN value > 10 THEN 'alto' ELSE 'baixo' END AS nivel FROM events")
def conditional(spark, sf):
    level = F.when(F.col("value") > 10, "alto").otherwise("baixo")
    return read(spark, sf, "events").select("event_id", analog.action(F.col("event_type")).alias("acao"), level.alias("nivel"))


@query("fn17_json_round_trip", "SELECT event_id, '{\"k\":\"' || json_extract_string(props, '$.k') || '\"}' AS json FROM events")
def json_round_trip(spark, sf):
    return read(spark, sf, "events").select("event_id", F.to_json(changes.decoded(F.col("props"))).alias("json"))


@query("udf1_gate", "SELECT s_suppkey, s_name IN ('Supplier#000000001', 'Supplier#000000002') AS pode_ver FROM supplier")
def gate(spark, sf):
    admins = tables.parse_list("Supplier#000000001, Supplier#000000002,,")
    return read(spark, sf, "supplier").select("s_suppkey", rows.member(F.col("s_name"), admins).alias("pode_ver"))


# State, in its batch form


@query(
    "st1_change_capture",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'excluiu' ELSE 'editou' END AS acao, c_mktsegment AS antes, CASE WHEN c_acctbal >= 0 THEN lower(c_mktsegment) END AS depois,
 CASE WHEN c_acctbal < 0 THEN 'c_custkey,c_mktsegment' ELSE 'c_mktsegment' END AS colunas
FROM customer WHERE c_acctbal < 0 OR c_mktsegment <> lower(c_mktsegment)
UNION ALL SELECT -1 - s_suppkey, 'criou', NULL, s_name, 'c_custkey,c_mktsegment' FROM supplier""",
)
def change_capture(spark, sf):
    secret = F.sha1("c_name").alias("senha")
    old = read(spark, sf, "customer").select("c_custkey", "c_mktsegment", secret)
    new = read(spark, sf, "customer").filter("c_acctbal >= 0").select("c_custkey", F.lower("c_mktsegment").alias("c_mktsegment"), secret)
    new = new.unionAll(read(spark, sf, "supplier").select((-1 - F.col("s_suppkey")).alias("c_custkey"), "s_name", F.lit("x")))
    found = rows.snapshot_diff(old, new, "c_custkey", hidden=("senha",))
    columns = F.array_join(F.map_keys(F.coalesce("depois", "antes")), ",")
    return found.select("c_custkey", "acao", F.col("antes")["c_mktsegment"].alias("antes"), F.col("depois")["c_mktsegment"].alias("depois"), columns.alias("colunas"))


#: Attempts among events: a purchase succeeds, a signup is none. Time runs 7200 times faster, so that the rules' own terms meet enough of them.
_AT, _AT_SQL = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) div 7200", "epoch_us(ts) // 7200"
_LIMIT = f"""WITH RECURSIVE a AS (SELECT event_id, user_id, us, ok, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM (SELECT event_id, user_id, {_AT_SQL} AS us, {{ok}} AS ok FROM events WHERE {{where}})),
r AS (SELECT 0::BIGINT AS i, user_id, 0::BIGINT AS opened, 0 AS n, NULL::BIGINT AS event_id, false AS rejected FROM (SELECT DISTINCT user_id FROM a)
 UNION ALL SELECT i, user_id, CASE WHEN m = 0 AND NOT ok THEN us ELSE opened END, CASE WHEN m >= {{most}} THEN m WHEN ok THEN 0 ELSE m + 1 END, event_id, m >= {{most}} FROM (
  SELECT a.*, r.opened, CASE WHEN a.us >= r.opened + 60000000 THEN 0 ELSE r.n END AS m FROM r JOIN a ON a.user_id = r.user_id AND a.i = r.i + 1))
SELECT event_id, rejected FROM r WHERE event_id IS NOT NULL"""


@query("st2_login_limiter", _LIMIT.format(ok="event_type = 'purchase'", where="event_type <> 'signup'", most=5))
def exact_login_limiter(spark, sf):
    tried = read(spark, sf, "events").filter("event_type <> 'signup'")
    return attempts.limited_rows(tried, "user_id", F.expr(_AT), F.col("event_type") == "purchase", "event_id")


@query("st3_throttle", _LIMIT.format(ok="false", where="true", most=6))
def exact_throttle(spark, sf):
    return attempts.limited_rows(read(spark, sf, "events"), "user_id", F.expr(_AT), F.lit(False), "event_id", attempts.THROTTLE_ATTEMPTS)


@query("st5_daily_reminders", f"""SELECT "EMPCODIGO", ("EMPDTEMPR" + INTERVAL 5 DAY)::DATE::VARCHAR AS dia FROM {_LOANS} WHERE "EMPDTDEVOL" IS NULL AND "EMPDTEMPR" + INTERVAL 5 DAY BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + INTERVAL 6 DAY""")
def daily_reminders(spark, sf):
    days = spark.range(7).select(F.date_add(F.lit(AS_OF).cast("date"), F.col("id").cast("int")).alias("dia"))
    return reports.due_on(analog.loans(spark, sf), days).select("EMPCODIGO", F.col("dia").cast("string").alias("dia"))


_WINDOWS = "SELECT user_id AS chave, time_bucket(INTERVAL '{w}', ts) AS inicio, count(*) AS tentativas FROM events WHERE event_type = 'error' GROUP BY ALL HAVING count(*) >= {n}"


@query("st2_login_limiter_windows", _WINDOWS.format(w="1 hour", n=2))
def login_limiter(spark, sf):
    failed = read(spark, sf, "events").filter("event_type = 'error'")
    return attempts.locked_out(failed, F.col("user_id"), most=2, decay="1 hour")


@query("st3_route_throttle", _WINDOWS.format(w="6 hours", n=3).replace("WHERE event_type = 'error' ", ""))
def route_throttle(spark, sf):
    return attempts.locked_out(read(spark, sf, "events"), F.col("user_id"), most=3, decay="6 hours")


@query(
    "st4_sessions",
    """SELECT user_id AS chave, min(ts) AS inicio, max(ts) + INTERVAL 120 MINUTE AS fim, count(*) AS eventos FROM (
 SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 120 MINUTE THEN 0 ELSE 1 END AS n FROM events)) GROUP BY user_id, s""",
)
def sessions(spark, sf):
    return attempts.sessions(read(spark, sf, "events"), F.col("user_id"))


# Extensions: rules of the documentation that have no code


@query("ext_open_loan_limit", f"""SELECT "EMPCLIENTE", count(*) AS abertos FROM {_LOANS} WHERE "EMPDTDEVOL" IS NULL GROUP BY "EMPCLIENTE" HAVING count(*) > 3""")
def open_loan_limit(spark, sf):
    return reports.over_limit(analog.loans(spark, sf), 3)


@query("ext_available_copies", """SELECT l_partkey AS "EXMLIVRO", count(*) FILTER (WHERE l_returnflag <> 'N') AS disponiveis, count(*) AS exemplares FROM lineitem GROUP BY l_partkey""")
def copies(spark, sf):
    return reports.available_copies(read(spark, sf, "lineitem").select(F.col("l_partkey").alias("EXMLIVRO"), (F.col("l_returnflag") != "N").alias("EXMDISPONIVEL")))
