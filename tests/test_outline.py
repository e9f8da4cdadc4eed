from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from samples import final_plan, tuples

from orderlens.operators import outline
from orderlens.sources.catalog import CatalogRoles


@pytest.fixture(scope="module")
def catalog(spark):
    make = spark.createDataFrame
    columns = [(t, c, f"t{t}c{c}", c % 2, 8, c % 2) for t, n in ((1, 3), (2, 25), (3, 3), (4, 2), (5, 2), (6, 2)) for c in range(1, n + 1)]
    columns.append((1, 9, "X_Sold_To_Y", 0, 8, 1))
    return CatalogRoles(
        tables=make(
            [(1, "one", 1, 0), (2, "two", 1, 0), (3, "abc", 1, 0), (4, "#tmp", 1, 0), (5, "shipped", 1, 1), (6, "inner", 2, 0)],
            "object_id int, name string, schema_id int, is_ms_shipped int",
        ),
        columns=make(columns, "object_id int, column_id int, name string, user_type_id int, max_length int, is_nullable int"),
        types=make([(0, "int"), (1, "text")], "user_type_id int, name string"),
        schemas=make([(1, "dbo"), (2, "sys")], "schema_id int, name string"),
        keys=make([(70, "FK70", 1, 2), (71, "FK71", 2, 1), (72, "FK72", 5, 1), (73, "FK73", 4, 1)], "object_id int, name string, parent_object_id int, referenced_object_id int"),
        key_columns=make(
            [(70, 1, 1, 2, 1), (70, 1, 2, 2, 2), (71, 2, 3, 1, 9), (72, 5, 1, 1, 1), (73, 4, 1, 1, 1)],
            "constraint_object_id int, parent_object_id int, parent_column_id int, referenced_object_id int, referenced_column_id int",
        ),
    )


def test_catalog_columns(catalog):
    found = outline.catalog_columns(catalog).orderBy(*outline.catalog_order()).collect()
    assert {r.table_name for r in found} == {"one", "two", "abc"}
    assert {r.table_name: r.has_relationships for r in found} == {"one": 2, "two": 1, "abc": 0}
    assert [r.table_name for r in found[:3]] == ["one"] * 3
    assert [r.column_name for r in found[:3]] == ["t1c1", "t1c2", "t1c3"]
    assert (found[0].data_type, found[0].is_nullable) == ("text", True)


def test_edges(catalog):
    found = sorted(tuples(outline.fk_edges(catalog, None).select("fk_name", "parent_table", "parent_column", "referenced_column")))
    # The shipped table has no edges, the denied column neither; temporary tables keep theirs.
    assert found == [
        ("FK70", "dbo.one", "t1c1", "t2c1"),
        ("FK70", "dbo.one", "t1c2", "t2c2"),
        ("FK73", "dbo.#tmp", "t4c1", "t1c1"),
    ]
    # FK73, then FK70, FK70, FK71 by table name: four rows taken, one then removed.
    assert outline.fk_edges(catalog, 4).count() == 3
    assert outline.fk_edges(catalog, 2).count() == 2


def test_groups_and_lines(catalog):
    groups = outline.schema_groups(outline.catalog_columns(catalog))
    found = {r.full_name: (r.group_rank, r.n_items, r.n_more, len(r["items"])) for r in groups.collect()}
    # Equal sizes: more relationships first.
    assert found == {"dbo.two": (1, 25, 5, 20), "dbo.one": (2, 3, 0, 3), "dbo.abc": (3, 3, 0, 3)}
    lines = [r.line for r in outline.outline_lines(groups).orderBy("group_rank", "line_no").collect()]
    assert lines[0] == "Table: dbo.two" and lines[1] == "  - t2c1 (text, NULL)"
    assert lines[21] == "  - ... and 5 more columns" and lines[22] == "Table: dbo.one"
    assert outline.schema_groups(outline.catalog_columns(catalog), top=1).count() == 1


def test_edge_lines(catalog):
    edges = outline.fk_edges(catalog)
    lines = [r.line for r in outline.edge_lines(edges).orderBy("line_no").collect()]
    assert lines == ["  - dbo.#tmp.t4c1 -> dbo.one.t1c1", "  - dbo.one.t1c1 -> dbo.two.t2c1", "  - dbo.one.t1c2 -> dbo.two.t2c2"]
    cut = [r.line for r in outline.edge_lines(edges, 1).orderBy("line_no").collect()]
    assert cut == [lines[0], "  - ... and 2 more relationships"]


def test_whole_outline(catalog):
    columns = outline.catalog_columns(catalog)
    text = outline.schema_outline("db", columns, outline.fk_edges(catalog)).collect()[0].outline
    assert text.startswith("Database: db\n\nTables and Columns:\nTable: dbo.two\n  - t2c1 (text, NULL)\n")
    assert "  - ... and 5 more columns\n\nTable: dbo.one\n" in text
    assert text.endswith("\n\nForeign Key Relationships:\n  - dbo.#tmp.t4c1 -> dbo.one.t1c1\n  - dbo.one.t1c1 -> dbo.two.t2c1\n  - dbo.one.t1c2 -> dbo.two.t2c2\n")
    without = outline.schema_outline("db", columns, outline.fk_edges(catalog).limit(0)).collect()[0].outline
    assert "Foreign Key" not in without


def test_items_are_cut_before_the_shuffle(catalog):
    plan = final_plan(outline.schema_groups(outline.catalog_columns(catalog)))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_limit_comes_before_filter(spark):
    df = spark.range(10)
    found = outline.limit_then_filter(df, [F.asc("id")], 4, F.col("id") % 2 == 1)
    assert sorted(r.id for r in found.collect()) == [1, 3]


def test_group_without_a_key_is_kept(spark):
    df = spark.createDataFrame([(None, i) for i in range(4)] + [("a", 9)], "g string, i int")
    found = outline.group_outline(df, ["g"], [F.col("i")], [F.asc("i")], [], top=5, per_group=3)
    assert sorted([(r.g, r.n_items, r.n_more, [x.i for x in r["items"]]) for r in found.collect()], key=repr) == [
        ("a", 1, 0, [9]),
        (None, 4, 1, [0, 1, 2]),
    ]
