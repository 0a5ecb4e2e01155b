"""Library tables seen in the driver's star-schema tables.

Part, customer, order lines and events stand for books, clients, loans and the
change log. Order lines have no key of their own: a loan is a row, and loans are
compared as multisets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day that stands for today.
AS_OF = "1995-02-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("LVRCODIGO"), F.col("p_name").alias("LVRTITULO"), F.col("p_brand").alias("LVRISBN"), F.col("p_size").alias("LVRFAIXAETARIA"))


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("CLICODIGO"), F.col("c_name").alias("CLINOME"))


def loans_of_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loans as far as the book matters: no join with orders."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("EMPCODIGO"), F.col("l_partkey").alias("EMPLIVRO"))


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line that was not returned is an open loan; its date is the order's."""
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    returned = F.when(F.col("l_returnflag") != "N", F.col("l_shipdate").cast("date"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("EMPCODIGO"),
        F.col("l_partkey").alias("EMPLIVRO"),
        F.col("l_suppkey").alias("EMPUSUARIO"),
        F.col("o_custkey").alias("EMPCLIENTE"),
        F.col("o_orderdate").cast("date").alias("EMPDTEMPR"),
        returned.alias("EMPDTDEVOL"),
    )


def action(kind: Column) -> Column:
    return F.when(kind == "signup", "criou").when(kind == "error", "excluiu").otherwise("editou")


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes: signup creates, error deletes, anything else edits."""
    after = F.to_json(F.struct(F.col("user_id").cast("string").alias("u"), F.col("event_type").alias("k")))
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("AUDCODIGO"),
        F.col("user_id").alias("AUDUSUARIO"),
        action(F.col("event_type")).alias("AUDACAO"),
        F.lit("events").alias("AUDTABELA"),
        F.col("event_id").alias("AUDREGISTRO"),
        F.when(action(F.col("event_type")) != "criou", F.col("props")).alias("AUDANTES"),
        F.when(action(F.col("event_type")) != "excluiu", after).alias("AUDDEPOIS"),
        F.col("ts").cast("timestamp").alias("AUDDATA"),
    )


def actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


def genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("GNRCODIGO"), F.col("n_name").alias("GNRNOME"))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("NVLCODIGO"), F.col("r_name").alias("NVLNOME"))


def staff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("USRCODIGO"), F.col("n_name").alias("USRNOME"), F.col("n_regionkey").cast("long").alias("USRNIVEL"))
