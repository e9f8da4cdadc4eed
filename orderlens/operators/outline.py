"""Catalog listings, foreign-key edges, and outlines of groups and their items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens import model as m
from orderlens.session import store
from orderlens.sources.catalog import CatalogRoles

# The lines and headings of an outline.
OUTLINE_HEAD = "Database: {database}\n\nTables and Columns:\n"
GROUP_LINE = "Table: %s"
ITEM_LINE = "  - %s (%s, %s)"
NULLABLE, NOT_NULLABLE = "NULL", "NOT NULL"
MORE_ITEMS = "  - ... and %d more columns"
EDGES_HEAD = "Foreign Key Relationships:\n"
EDGE_LINE = "  - %s.%s -> %s.%s"
MORE_EDGES = "  - ... and %d more relationships"



def denied(name: str, part: str = m.DENIED_NAME) -> Column:
    return F.lower(F.col(name)).contains(part)


def user_tables(catalog: CatalogRoles) -> DataFrame:
    return catalog.tables.filter(F.col("is_ms_shipped") == 0)


def relationship_counts(catalog: CatalogRoles) -> DataFrame:
    """Key columns per parent table; a composite key counts once per column."""
    return (
        catalog.key_columns.join(
            catalog.keys.select(F.col("object_id").alias("constraint_object_id")), "constraint_object_id"
        )
        .groupBy(F.col("parent_object_id").alias("object_id"))
        .agg(F.count("*").alias("has_relationships"))
    )


def catalog_columns(catalog: CatalogRoles) -> DataFrame:
    """Every column of every user table, without denied columns, system schemas and ``#`` tables."""
    tables = user_tables(catalog).select("object_id", "schema_id", F.col("name").alias("table_name"))
    schemas = catalog.schemas.select("schema_id", F.col("name").alias("schema_name"))
    types = catalog.types.select("user_type_id", F.col("name").alias("data_type"))
    # One row per table. Stored, so that its join with the columns is between
    # freshly shuffled sides and the partition of a very wide table can be split.
    listed = store(
        tables.filter(~F.col("table_name").startswith("#"))
        .join(schemas.filter(~F.col("schema_name").isin(*m.SYSTEM_SCHEMAS)), "schema_id")
        .join(relationship_counts(catalog), "object_id", "left")
        .select(
            "object_id",
            "schema_name",
            "table_name",
            F.coalesce("has_relationships", F.lit(0)).alias("has_relationships"),
        ),
        "listed-tables",
    )
    columns = catalog.columns.select(
        "object_id", "column_id", F.col("name").alias("column_name"), "user_type_id", "max_length", "is_nullable"
    ).filter(~denied("column_name"))
    return (
        columns.join(listed, "object_id")
        .join(types, "user_type_id")
        .select(
            "schema_name",
            "table_name",
            "column_name",
            "data_type",
            "max_length",
            F.col("is_nullable").cast("boolean").alias("is_nullable"),
            "has_relationships",
            "column_id",
        )
    )


def catalog_order() -> list[Column]:
    return [F.desc("has_relationships"), F.asc("table_name"), F.asc("column_id")]


def edges(catalog: CatalogRoles) -> DataFrame:
    """Foreign-key column pairs between user tables, both ends named."""
    tables = user_tables(catalog)
    names: dict[str, DataFrame] = {}
    columns: dict[str, DataFrame] = {}
    for end in ("parent", "referenced"):
        names[end] = tables.join(
            catalog.schemas.select("schema_id", F.col("name").alias("schema_name")), "schema_id"
        ).select(
            F.col("object_id").alias(f"{end}_object_id"),
            F.col("name").alias(f"{end}_name"),
            F.concat_ws(".", "schema_name", "name").alias(f"{end}_table"),
        )
        columns[end] = catalog.columns.select(
            F.col("object_id").alias(f"{end}_object_id"),
            F.col("column_id").alias(f"{end}_column_id"),
            F.col("name").alias(f"{end}_column"),
        )
    keys = catalog.keys.select(F.col("object_id").alias("constraint_object_id"), F.col("name").alias("fk_name"))
    return (
        catalog.key_columns.join(keys, "constraint_object_id")
        .join(names["parent"], "parent_object_id")
        .join(names["referenced"], "referenced_object_id")
        .join(columns["parent"], ["parent_object_id", "parent_column_id"])
        .join(columns["referenced"], ["referenced_object_id", "referenced_column_id"])
        .select(
            "fk_name",
            "parent_table",
            "parent_column",
            "referenced_table",
            "referenced_column",
            "parent_name",
            "referenced_name",
        )
    )


def edge_order() -> list[Column]:
    first = ["parent_name", "referenced_name"]
    return [F.asc(c) for c in [*first, "fk_name", "parent_column", "referenced_column", "parent_table", "referenced_table"]]


def limit_then_filter(df: DataFrame, order: Sequence[Column], n: int, keep: Column) -> DataFrame:
    """Filter the first ``n`` rows: fewer may remain."""
    return df.orderBy(*order).limit(n).filter(keep)


def fk_edges(catalog: CatalogRoles, n: int | None = m.EDGES_READ) -> DataFrame:
    """The first ``n`` edges (all if None), less those with a denied column at either end."""
    keep = ~(denied("parent_column") | denied("referenced_column"))
    found = edges(catalog)
    return found.filter(keep) if n is None else limit_then_filter(found, edge_order(), n, keep)


def edge_lines(found: DataFrame, shown: int = m.EDGES_SHOWN) -> DataFrame:
    """``found`` as numbered text lines, the last telling how many are left out."""
    # Stored, so that lines and count come from one evaluation of the joins.
    found = store(found, "edges")
    text = F.format_string(EDGE_LINE, "parent_table", "parent_column", "referenced_table", "referenced_column")
    # At most `shown` rows are left when they are numbered.
    lines = (
        found.orderBy(*edge_order())
        .limit(shown)
        .select(F.row_number().over(Window.orderBy(*edge_order())).cast("long").alias("line_no"), text.alias("line"))
    )
    rest = found.agg((F.count("*") - shown).alias("more")).filter(F.col("more") > 0)
    return lines.unionByName(
        rest.select(F.lit(shown + 1).cast("long").alias("line_no"), F.format_string(MORE_EDGES, "more").alias("line"))
    )


def group_outline(
    df: DataFrame,
    groups: Sequence[str],
    items: Sequence[Column],
    item_order: Sequence[Column],
    ties: Sequence[Column],
    top: int = m.OUTLINE_GROUPS,
    per_group: int = m.OUTLINE_ITEMS,
) -> DataFrame:
    """The ``top`` largest groups, each with its size, its first items and how many are left out.

    ``ties`` orders groups of equal size by aggregates. Groups are counted
    and cut first, so that items are ranked for the kept groups only.
    """
    tie_names = [f"_tie{i}" for i in range(len(ties))]
    sizes = df.groupBy(*groups).agg(F.count("*").alias("n_items"), *[t.alias(n) for t, n in zip(ties, tie_names)])
    ranking = [F.desc("n_items"), *[F.asc(n) for n in tie_names], *[F.asc(g) for g in groups]]
    # At most `top` rows are left when they are numbered, and broadcast.
    # The key is a struct, as its NULL fields compare equal.
    key = F.struct(*groups).alias("_group")
    largest = (
        sizes.orderBy(*ranking)
        .limit(top)
        .select(key, "n_items", F.row_number().over(Window.orderBy(*ranking)).alias("group_rank"))
    )
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(*item_order))
    return (
        df.select("*", key)
        .join(F.broadcast(largest), "_group")
        .withColumn("place", place)
        .filter(F.col("place") <= per_group)
        .groupBy(*groups, "group_rank", "n_items")
        .agg(F.sort_array(F.collect_list(F.struct("place", *items))).alias("items"))
        .withColumn("n_more", F.greatest(F.col("n_items") - per_group, F.lit(0)))
    )


def schema_groups(columns: DataFrame, top: int = m.OUTLINE_GROUPS, per_group: int = m.OUTLINE_ITEMS) -> DataFrame:
    """The outline of ``catalog_columns``: largest tables with their first columns."""
    full = columns.withColumn("full_name", F.concat_ws(".", "schema_name", "table_name"))
    return group_outline(
        full,
        ["full_name"],
        [F.col("column_name"), F.col("data_type"), F.col("is_nullable")],
        [F.asc("column_id"), F.asc("column_name")],
        [F.max(-F.col("has_relationships")), F.min("table_name")],
        top,
        per_group,
    )


def outline_lines(groups: DataFrame) -> DataFrame:
    """Text lines of ``schema_groups``, numbered by group and line."""

    def line(number: Column, text: Column) -> Column:
        return F.struct(number.cast("int").alias("line_no"), text.alias("line"))

    def item(x: Column) -> Column:
        label = F.when(x["is_nullable"], NULLABLE).otherwise(NOT_NULLABLE)
        return line(x["place"], F.format_string(ITEM_LINE, x["column_name"], x["data_type"], label))

    head = F.array(line(F.lit(0), F.format_string(GROUP_LINE, "full_name")))
    more = F.array(line(F.size("items") + 1, F.format_string(MORE_ITEMS, "n_more")))
    rest = F.when(F.col("n_more") > 0, more).otherwise(F.slice(more, 1, 0))
    return groups.select("group_rank", F.inline(F.concat(head, F.transform("items", item), rest)))


def schema_outline(database: str, columns: DataFrame, found: DataFrame) -> DataFrame:
    """The whole outline as one text: bounded by the group, item and edge limits."""
    tables = (
        outline_lines(schema_groups(columns))
        .groupBy("group_rank")
        .agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])).alias("block"))
        .agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("group_rank", "block"))), lambda x: F.concat(x["block"], F.lit("\n\n")))).alias("tables"))
    )
    links = edge_lines(found).agg(
        F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: F.concat(x["line"], F.lit("\n")))).alias("edges")
    )
    head = OUTLINE_HEAD.format(database=database)
    links_text = links.select(F.when(F.col("edges") != "", F.concat(F.lit(EDGES_HEAD), "edges")).otherwise("")).scalar()
    return tables.select(F.concat(F.lit(head), F.coalesce("tables", F.lit("")), links_text).alias("outline"))
