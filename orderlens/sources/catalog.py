"""Catalog metadata tables: of a database, of the session, or derived from a star schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderlens import model as m
from orderlens.session import store
from orderlens.sources.roles import table

# The five derived types.
TYPE_NAMES = ("bigint", "varchar", "float", "datetime", "int")


@dataclass(frozen=True)
class CatalogRoles:
    """Tables, columns, types, schemas, foreign keys and their columns."""

    tables: DataFrame
    columns: DataFrame
    types: DataFrame
    schemas: DataFrame
    keys: DataFrame
    key_columns: DataFrame


_built: dict[tuple[str, str], CatalogRoles] = {}


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem")


def _columns(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select("p_partkey", "p_size")
    return (
        _lines(spark, folder)
        .select("l_suppkey", "l_partkey")
        .distinct()
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_suppkey").alias("object_id"),
            (F.col("l_partkey") + 1).alias("column_id"),
            F.concat(
                F.when(F.col("p_size") == 50, "SOLD_TO_").otherwise("c_"), F.col("l_partkey").cast("string")
            ).alias("name"),
            (F.col("l_partkey") % 5).cast("int").alias("user_type_id"),
            F.col("p_size").alias("max_length"),
            (F.col("l_partkey") % 2).cast("int").alias("is_nullable"),
        )
    )


def _first_two_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The first two lines of every order that has two, as columns of one row."""
    by_order = Window.partitionBy("l_orderkey").orderBy("l_suppkey", "l_partkey", "l_linenumber", "l_extendedprice")
    first = F.col("line") == 1
    second = F.col("line") == 2
    return (
        _lines(spark, folder)
        .select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_extendedprice")
        .withColumn("line", F.row_number().over(by_order))
        .filter(F.col("line") <= 2)
        .groupBy("l_orderkey")
        .agg(
            F.max(F.when(first, F.col("l_suppkey"))).alias("parent"),
            F.max(F.when(first, F.col("l_partkey"))).alias("parent_part"),
            F.max(F.when(second, F.col("l_suppkey"))).alias("referenced"),
            F.max(F.when(second, F.col("l_partkey"))).alias("referenced_part"),
        )
        .filter(F.col("referenced").isNotNull())
    )


def catalog_roles(spark: SparkSession, folder: str, refresh: bool = False) -> CatalogRoles:
    """Metadata tables derived from the star schema in ``folder``.

    Columns and key pairs are stored tables, written once per application.
    """
    where = (spark.sparkContext.applicationId, folder)
    if not refresh and where in _built:
        return _built[where]
    schemas = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("schema_id"),
        F.when(F.col("n_nationkey") == 0, "sys").otherwise(F.col("n_name")).alias("name"),
    )
    tables = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("object_id"),
        F.when(F.col("s_suppkey") % 17 == 3, F.concat(F.lit("#"), "s_name")).otherwise(F.col("s_name")).alias("name"),
        F.col("s_nationkey").alias("schema_id"),
        (F.col("s_suppkey") % 10 == 9).cast("int").alias("is_ms_shipped"),
    )
    values = ", ".join(f"({number}, '{name}')" for number, name in enumerate(TYPE_NAMES))
    types = spark.sql(f"SELECT * FROM VALUES {values} AS t(user_type_id, name)")
    columns = store(_columns(spark, folder), "columns")
    pairs = store(_first_two_lines(spark, folder), "key-pairs")
    smallest = columns.groupBy("object_id").agg(F.min("column_id").alias("column_id"))
    keys = pairs.select(
        F.col("l_orderkey").alias("object_id"),
        F.concat(F.lit("FK_"), F.col("l_orderkey").cast("string")).alias("name"),
        F.col("parent").alias("parent_object_id"),
        F.col("referenced").alias("referenced_object_id"),
    )
    single = pairs.select(
        F.col("l_orderkey").alias("constraint_object_id"),
        F.col("parent").alias("parent_object_id"),
        (F.col("parent_part") + 1).alias("parent_column_id"),
        F.col("referenced").alias("referenced_object_id"),
        (F.col("referenced_part") + 1).alias("referenced_column_id"),
    )
    # Every fifth key is composite.
    composite = (
        pairs.filter(F.col("l_orderkey") % 5 == 0)
        .join(smallest.toDF("parent", "parent_column_id"), "parent")
        .join(smallest.toDF("referenced", "referenced_column_id"), "referenced")
        .select(
            F.col("l_orderkey").alias("constraint_object_id"),
            F.col("parent").alias("parent_object_id"),
            "parent_column_id",
            F.col("referenced").alias("referenced_object_id"),
            "referenced_column_id",
        )
    )
    _built[where] = CatalogRoles(tables, columns, types, schemas, keys, single.unionByName(composite))
    return _built[where]


def session_columns(spark: SparkSession, database: str) -> DataFrame:
    """The columns of the session's own tables, as ``catalog_columns`` lists them.

    For catalogs of a size a person browses: names and columns are listed on
    the driver, with one catalog call for the tables and one for each of them.
    Spark keeps no foreign keys, so ``has_relationships`` is 0.
    """
    rows = [
        (database, found.name, column.name, column.dataType, None, column.nullable, 0, place)
        for found in spark.catalog.listTables(database)
        for place, column in enumerate(spark.catalog.listColumns(found.name if found.isTemporary else f"{database}.{found.name}"), 1)
    ]
    schema = (
        "schema_name string, table_name string, column_name string, data_type string, max_length int, "
        "is_nullable boolean, has_relationships bigint, column_id int"
    )
    return spark.createDataFrame(rows, schema).filter(~F.lower("column_name").contains(m.DENIED_NAME))
