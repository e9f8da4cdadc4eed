"""Which queries may run: a check of a query's plan before anything is run.

Spark parses the text, and every node of the parsed plan must be of a kind that
a SELECT is made of, every function one of Spark's own of a harmless group, and
every relation a published view or a named query of the text. So commands,
scripts, static Java methods, table functions over files or servers, and names
given as expressions are refused by not being on a list. The analyzed plan is
walked as well: it shows what names stand for. Rows may come from published
views and from the text itself only, and session variables, user functions
and functions in a named window that the parsed plan hides are refused there.

Columns are denied by name, at any depth: references to one are refused, and
``without_denied`` takes the fields out of structs, arrays and maps.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from functools import lru_cache
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from orderlens import model as m


class RefusedQuery(ValueError):
    """The query has a part that may not run."""


# Names of Spark's plan nodes that a SELECT consists of, as parsed.
PARSED_NODES = frozenset(
    """
    Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation
    PipeOperator Pivot Project Sample Sort SubqueryAlias Union Unpivot UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedRelation
    UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedWith Window
    WithWindowDefinition
    """.split()
)
# Those of an analyzed SELECT that bring rows without a relation.
ROW_SOURCES = frozenset("OneRowRelation LocalRelation Range CTERelationRef UnionLoopRef".split())
# What Spark calls a column, a function or a star that is not resolved yet.
PARSED_NAMES = frozenset(
    """
    MultiAlias UnresolvedAlias UnresolvedAttribute UnresolvedExtractValue UnresolvedFunction UnresolvedGenerator UnresolvedOrdinal
    UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedStarWithColumns
    """.split()
)
# Groups that Spark sorts its own functions into.
FUNCTION_GROUPS = frozenset(
    """
    agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs datetime_funcs
    generator_funcs hash_funcs json_funcs lambda_funcs map_funcs math_funcs predicate_funcs st_funcs string_funcs
    struct_funcs url_funcs variant_funcs window_funcs xml_funcs
    """.split()
)
# Harmless functions that Spark sorts elsewhere, and table functions over their arguments.
MORE_FUNCTIONS = frozenset("typeof equal_null".split())
TABLE_FUNCTIONS = frozenset(
    "explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple range variant_explode variant_explode_outer".split()
)
# Expressions that run code or read the session.
REFUSED_EXPRESSIONS = frozenset(
    """
    CallMethodViaReflection TryReflect VariableReference PythonUDF PythonUDAF PythonUDTF ScalaUDF ScalaUDAF
    ScalaAggregator HiveSimpleUDF HiveGenericUDF HiveGenericUDTF HiveUDAFFunction CurrentUser SessionUser CurrentDatabase
    CurrentCatalog InputFileName InputFileBlockStart InputFileBlockLength SparkVersion
    ExpressionWithUnresolvedIdentifier
    """.split()
)
EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."


def _items(found: Any) -> list[Any]:
    return [found.apply(i) for i in range(found.size())]


def _kind(node: Any) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _plans(plan: Any) -> Iterator[Any]:
    """The plan's nodes and those of its subqueries and named queries."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        if _kind(node) != "View":
            # Named and scalar queries are inner children.
            todo += [x for x in [*_items(node.children()), *_items(node.innerChildren())] if hasattr(x, "expressions")]


def _expressions(plan: Any) -> Iterator[Any]:
    todo = _items(plan.expressions())
    while todo:
        node = todo.pop()
        yield node
        todo += _items(node.children())


@lru_cache(maxsize=4096)
def _group(spark: SparkSession, name: str) -> str | None:
    """The group of one of Spark's own functions; None if there is no such function."""
    catalyst = spark._jvm.org.apache.spark.sql.catalyst
    registry = getattr(getattr(catalyst.analysis, "FunctionRegistry$"), "MODULE$").builtin()
    found = registry.lookupFunction(catalyst.FunctionIdentifier(name))
    return found.get().getGroup() if found.isDefined() else None


def _check_function(spark: SparkSession, parts: list[str], functions: Collection[str]) -> None:
    name = ".".join(parts).lower()
    if name in functions:
        return
    if len(parts) > 1 or not (name in MORE_FUNCTIONS or _group(spark, name) in FUNCTION_GROUPS):
        raise RefusedQuery(f"function {name} may not be used")


def is_denied(name: str, denied: str = m.DENIED_NAME) -> bool:
    return denied.lower() in name.lower()


def _check_parsed(spark: SparkSession, plan: Any, relations: Collection[str], functions: Collection[str]) -> None:
    nodes = list(_plans(plan))
    named = {p._1().lower() for n in nodes if _kind(n) == "UnresolvedWith" for p in _items(n.cteRelations())}
    for node in nodes:
        kind = _kind(node)
        if kind not in PARSED_NODES:
            raise RefusedQuery(f"{kind} is no part of a query that may run")
        if kind == "UnresolvedRelation":
            parts = [p.lower() for p in _items(node.multipartIdentifier())]
            if len(parts) > 1 or parts[0] not in named and parts[0] not in relations:
                raise RefusedQuery(f"no relation {'.'.join(parts)}")
        elif kind == "UnresolvedTableValuedFunction":
            name = ".".join(_items(node.name())).lower()
            if name not in TABLE_FUNCTIONS:
                raise RefusedQuery(f"table function {name} may not be used")
        for expression in _expressions(node):
            kind = _kind(expression)
            if kind not in PARSED_NAMES and (kind in REFUSED_EXPRESSIONS or not _is_plain(expression)):
                raise RefusedQuery(f"{kind} may not be used")
            if kind == "UnresolvedFunction":
                _check_function(spark, _items(expression.nameParts()), functions)
            elif kind == "UnresolvedGenerator":
                _check_function(spark, [expression.name().unquotedString()], functions)
            elif kind == "UnresolvedAttribute" and any(map(is_denied, _items(expression.nameParts()))):
                raise RefusedQuery("a denied column is named")


def _is_plain(expression: Any) -> bool:
    return expression.getClass().getName().startswith(EXPRESSIONS)


def _check_analyzed(plan: Any, relations: Collection[str], functions: Collection[str]) -> None:
    for node in _plans(plan):
        kind = _kind(node)
        if kind == "View":
            name = node.desc().identifier().table().lower()
            if name not in relations:
                raise RefusedQuery(f"no relation {name}")
            continue
        if not _items(node.children()) and kind not in ROW_SOURCES:
            raise RefusedQuery(f"{kind} may not be read")
        for expression in _expressions(node):
            if _kind(expression) in REFUSED_EXPRESSIONS and not functions:
                raise RefusedQuery(f"{_kind(expression)} may not be used")


def checked(spark: SparkSession, sql: str, relations: Collection[str], functions: Collection[str] = ()) -> DataFrame:
    """The result of ``sql``, one SELECT over views named in ``relations``; nothing has run yet.

    Raises ``RefusedQuery`` if the plan has a part that may not run, and Spark's
    own error if the text is no query. ``functions`` names registered functions
    that are allowed besides Spark's own; what these do is not looked into.
    """
    allowed = {name.lower() for name in relations}
    own = {name.lower() for name in functions}
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    _check_parsed(spark, parsed, allowed, own)
    found = spark.sql(sql)
    _check_analyzed(found._jdf.queryExecution().analyzed(), allowed, own)
    return found


def keeps_order(df: DataFrame) -> bool:
    """Whether the rows come sorted: a sort with nothing above it but what keeps the order."""
    node = df._jdf.queryExecution().analyzed()
    while _kind(node) in ("Project", "GlobalLimit", "LocalLimit", "Offset", "SubqueryAlias", "WithCTE"):
        # The query stands before its named queries.
        node = _items(node.children())[-1 if _kind(node) == "WithCTE" else 0]
    return _kind(node) == "Sort" and getattr(node, "global")()


def _cleaned(value: Column, kind: DataType, denied: str) -> Column:
    if isinstance(kind, StructType):
        kept = [f for f in kind.fields if not is_denied(f.name, denied)]
        if not kept:
            return F.when(value.isNotNull(), F.struct())
        fields = [_cleaned(value.getField(f.name), f.dataType, denied).alias(f.name) for f in kept]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _cleaned(x, kind.elementType, denied))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: _cleaned(x, kind.valueType, denied))
    return value


def _holds_denied(kind: DataType, denied: str) -> bool:
    if isinstance(kind, StructType):
        return any(is_denied(f.name, denied) or _holds_denied(f.dataType, denied) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _holds_denied(kind.elementType, denied)
    return isinstance(kind, MapType) and _holds_denied(kind.valueType, denied)


def without_denied(df: DataFrame, denied: str = m.DENIED_NAME) -> DataFrame:
    """``df`` without columns and nested fields whose name contains ``denied``, whatever its case.

    Works by position, so that repeated column names are kept.
    """
    fields = df.schema.fields
    numbered = df.toDF(*[f"c{i}" for i in range(len(fields))])
    kept = []
    for i, field in enumerate(fields):
        if not is_denied(field.name, denied):
            value = F.col(f"c{i}")
            kept.append(_cleaned(value, field.dataType, denied) if _holds_denied(field.dataType, denied) else value)
    names = [f.name for f in fields if not is_denied(f.name, denied)]
    return numbered.select(*kept).toDF(*names) if kept else numbered.select()
