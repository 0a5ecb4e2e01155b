"""Readers: typed Parquet tables, JDBC, storage disks, lists in settings, point lookups, made-up rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import SCHEMAS

#: JDBC driver class and URL form of each supported database.
JDBC = {
    "sqlite": ("org.sqlite.JDBC", "jdbc:sqlite:{database}"),
    "mysql": ("com.mysql.cj.jdbc.Driver", "jdbc:mysql://{host}:{port}/{database}"),
    "mariadb": ("org.mariadb.jdbc.Driver", "jdbc:mariadb://{host}:{port}/{database}"),
    "pgsql": ("org.postgresql.Driver", "jdbc:postgresql://{host}:{port}/{database}"),
    "sqlsrv": ("com.microsoft.sqlserver.jdbc.SQLServerDriver", "jdbc:sqlserver://{host}:{port};databaseName={database}"),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A library table with its declared schema: nothing is inferred."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def jdbc_options(kind: str, *, table: str, partition: tuple[str, int, int, int] | None = None, **at: str) -> dict[str, str]:
    """Options of a JDBC read; ``partition`` (column, lower, upper, parts) makes it parallel."""
    driver, url = JDBC[kind]
    out = {"driver": driver, "url": url.format(**at), "dbtable": table}
    out |= {k: at[k] for k in ("user", "password") if k in at}
    if partition:
        out |= dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, partition)))
    return out


def jdbc(spark: SparkSession, kind: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(kind, **options)).load()


def disk_path(disk: str, path: str, *, root: str = "", bucket: str = "") -> str:
    """Where a path of a storage disk is: local, public or s3."""
    path = path.lstrip("/")
    if disk == "s3":
        return f"s3a://{bucket}/{path}"
    if disk in ("local", "public"):
        return f"file://{root.rstrip('/')}/{'private' if disk == 'local' else 'public'}/{path}"
    raise ValueError(f"no such disk: {disk}")


def parse_list(setting: str | None) -> list[str]:
    """Comma-separated settings: trimmed, without empty entries and "0"."""
    return [x for x in (p.strip() for p in (setting or "").split(",")) if x not in ("", "0")]


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup by primary key; the predicate reaches the Parquet reader."""
    return df.filter(F.col(key) == F.lit(value))


def by_key_and_hash(df: DataFrame, key: str, value, hashed: str, digest: str) -> DataFrame:
    """Point lookup that also proves knowledge of a column by its SHA-1."""
    return df.filter((F.col(key) == F.lit(value)) & (F.sha1(hashed) == F.lit(digest)))


def by_unique_key(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value)).limit(1)


def made_up_users(spark: SparkSession, n: int, as_of: str, verified: bool = True, **literal) -> DataFrame:
    """n accounts from their numbers alone, the same each time; ``literal`` replaces columns."""
    ids = spark.range(1, n + 1)
    when: Column = F.lit(as_of).cast("timestamp")
    users = ids.select(
        "id",
        F.concat(F.lit("User "), "id").alias("name"),
        F.concat(F.lit("user"), F.col("id"), F.lit("@example.org")).alias("email"),
        (when if verified else F.lit(None).cast("timestamp")).alias("email_verified_at"),
        F.sha2(F.concat(F.lit("password"), F.col("id")), 256).alias("password"),
        F.substring(F.sha1(F.col("id").cast("string")), 1, 10).alias("remember_token"),
        when.alias("created_at"),
        when.alias("updated_at"),
    )
    return users.withColumns({k: F.lit(v).cast(SCHEMAS["users"][k].dataType) for k, v in literal.items()})
