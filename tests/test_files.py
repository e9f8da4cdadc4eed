from __future__ import annotations

import glob

import pandas as pd
from pyspark.sql import functions as F
from samples import tuples

from orderlens.functions.connections import connection_fields
from orderlens import model as m
from orderlens.sources import files, jdbc

XML = """<?xml version="1.0" encoding="utf-8"?>
<Config>
<Company><Name>A</Name><ServerName>s1</ServerName></Company>
<Company><n>B</n><ServerName>s2</ServerName></Company>
<Company><Name></Name><n>C</n><ServerName></ServerName><ConnectionString>Data Source=s3;Initial Catalog=d</ConnectionString></Company>
<Company><Name>D</Name></Company>
<Company><Name>E</Name><ConnectionString>Initial Catalog=d</ConnectionString></Company>
<Company><ServerName>s6</ServerName></Company>
</Config>
"""


def test_company_files(spark, tmp_path):
    (tmp_path / "config.xml").write_text(XML)
    found = files.read_companies(spark, str(tmp_path / "config.xml"))
    assert sorted(tuples(found)) == [("", "s6"), ("A", "s1"), ("B", "s2"), ("C", "s3")]


def test_connection_fields(spark):
    texts = [
        "data source=s;initial catalog=d;User ID=u;Password=p",
        "PASSWORD=a=b;DATA SOURCE=x y",
        "Data Source=;Initial Catalog=d",
        "",
        None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = [tuple(r) for r in df.orderBy("i").select(*connection_fields(F.col("t"))).collect()]
    assert found == [
        ("s", "d", "u", "p"),
        ("x y", None, None, "a=b"),
        (None, "d", None, None),
        (None, None, None, None),
        (None, None, None, None),
    ]


ROWS = [
    (1, 'say "hi"', 1.0),
    (2, "a,b", None),
    (3, "two\nlines", 2.5),
    (4, None, -3.0),
    (5, " padded ", 0.1),
    (6, "plain é", 100.0),
]


def test_csv_bytes_equal_pandas(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id int, text string, value double")
    files.write_csv(df.orderBy("id").coalesce(1), str(tmp_path / "out"))
    [part] = glob.glob(f"{tmp_path}/out/part-*.csv")
    expected = pd.DataFrame(ROWS, columns=["id", "text", "value"]).to_csv(index=False).encode("utf-8")
    assert open(part, "rb").read() == expected


def test_csv_roundtrip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id int, text string, value double").repartition(3)
    files.write_csv(df, str(tmp_path / "out"))
    assert sorted(tuples(files.read_csv(spark, str(tmp_path / "out"), df.schema))) == sorted(ROWS)


def test_jdbc_options():
    assert jdbc.connection_options("s", "d") == {"url": "jdbc:sqlserver://s;databaseName=d;integratedSecurity=true"}
    assert jdbc.connection_options("s", "d", "u", "p")["user"] == "u"


def test_jdbc_split_options():
    assert jdbc.split_options("k", (10, 109), 4) == {
        "partitionColumn": "k", "lowerBound": "10", "upperBound": "110", "numPartitions": "4",
    }
    assert jdbc.split_options("k", (1, 3), 8)["numPartitions"] == "3"
    for bounds, parts in ((None, 4), ((5, 5), 4), ((1, 9), 1)):
        assert jdbc.split_options("k", bounds, parts) == {}


def test_jdbc_bounds_are_asked_per_table_and_key(spark, monkeypatch):
    """No database: only the queries and options are looked at."""
    asked, read = [], {}

    def bounds(session, options, name, key):
        asked.append((name, key))
        return (len(asked), 100 * len(asked))

    class Reader:
        def __init__(self):
            self.given = {}

        def format(self, kind):
            assert kind == "jdbc"
            return self

        def options(self, **more):
            self.given |= more
            return self

        def option(self, name, value):
            return self.options(**{name: value})

        def load(self):
            read[self.given["dbtable"]] = self.given
            return spark.range(1)

    class Session:
        sparkContext = spark.sparkContext

        @property
        def read(self):
            return Reader()

    monkeypatch.setattr(jdbc, "key_bounds", bounds)
    jdbc.order_tables(Session(), {"url": "jdbc:x"})
    assert asked == [(m.HIST_TABLE, m.ORDER), (m.HEADER_TABLE, m.HEADER_ID), (m.DETAIL_TABLE, m.HEADER_ID), (m.JOURNAL_TABLE, m.HEADER_ID)]
    for number, (name, key) in enumerate(asked, 1):
        assert (read[name]["partitionColumn"], read[name]["lowerBound"]) == (key, str(number))
        assert read[name]["numPartitions"] == str(spark.sparkContext.defaultParallelism)
    assert "partitionColumn" not in read[m.GROUP_TABLE] and read[m.GROUP_TABLE]["fetchsize"] == jdbc.FETCH_ROWS


def test_jdbc_shares_cut_every_row_once(spark):
    """Conditions run on a table of text keys, quotes and nulls among them."""
    keys = ["A-1", "a-2", "b'c", "", None, "Zz", "\u00e9t\u00e9", "b'c", "10", "9"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    for edges in (["", "A-1", "b'c"], ["10", "9"], ["", "Zz", "a-2", "b'c", "\u00e9t\u00e9"]):
        predicates = jdbc.share_predicates("k", edges)
        assert len(predicates) == len(edges)
        assert sum(df.filter(p).count() for p in predicates) == len(keys)
    assert jdbc.share_predicates("k", ["a"]) == jdbc.share_predicates("k", []) == []
    assert jdbc.share_predicates("k", [1, 5, 9]) == ["k < 5 OR k IS NULL", "k >= 5 AND k < 9", "k >= 9"]


def test_jdbc_text_keys_are_read_by_shares(spark, monkeypatch):
    """No database: the edges come from Spark SQL, and the options are looked at."""
    table = spark.createDataFrame([(f"No {n:03d}", n) for n in range(97)] + [("No 000", 0)] * 50, f"{m.ORDER} string, n int")
    table.createOrReplaceTempView("text_keys")
    given = {}

    class Reader:
        def format(self, kind):
            return self

        def options(self, **more):
            return self

        def option(self, name, value):
            return self

        def load(self):
            return table

        def jdbc(self, url, name, predicates, properties):
            given.update(url=url, name=name, predicates=predicates, properties=properties)
            return table

    class Session:
        sparkContext = spark.sparkContext
        read = Reader()

    monkeypatch.setattr(jdbc, "read_query", lambda session, options, query: spark.sql(query))
    options = {"url": "jdbc:x", "user": "u"}
    assert jdbc.read_table(Session(), options, "text_keys", m.ORDER, 4) is table
    assert (given["url"], given["name"], given["properties"]) == ("jdbc:x", "text_keys", {"user": "u", "fetchsize": "10000"})
    sizes = [table.filter(p).count() for p in given["predicates"]]
    assert sum(sizes) == table.count() and len(sizes) == 3 and max(sizes) <= 2 * 37
    given.clear()
    jdbc.read_table(Session(), options, "text_keys", "n", 4, shares=True)
    assert sum(table.filter(p).count() for p in given["predicates"]) == table.count()


def test_the_pushed_join_is_the_base_relation(spark, folder):
    from orderlens.operators import base
    from orderlens.plans import ask
    from orderlens.sources.roles import order_roles

    tables = order_roles(spark, folder)
    ask.register(tables)
    pushed = spark.sql(jdbc.base_query(None))
    assert pushed.columns == m.BASE_COLUMNS
    assert sorted(tuples(pushed), key=repr) == sorted(tuples(base.base_orders(tables)), key=repr)
    cut = jdbc.base_query(50)
    assert cut.startswith("SELECT TOP 50 ")
    # Spark has LIMIT for TOP.
    first = spark.sql(cut.replace("SELECT TOP 50 ", "SELECT ").replace("j.ORDER_JRNL_CMT_TXT DESC", "j.ORDER_JRNL_CMT_TXT DESC NULLS LAST") + " LIMIT 50")
    assert tuples(first) == tuples(base.top_comments(base.base_orders(tables), 50))
