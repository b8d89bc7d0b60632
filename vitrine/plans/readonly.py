"""Read-only SQL over the marts, and the mart catalog.

The text is placed inside ``SELECT * FROM ( ... ) q``, where Spark's grammar admits
only a query: DML, DDL, ``WITH ... INSERT``, several statements and parenthesis
escapes fail to parse. Every function that the parse tree names must be one that Spark itself
brings and that nobody has replaced in this session; so functions registered from Python, Scala or
Hive, SQL functions and table functions are refused by their names, before analysis could run any
code of theirs. What passes is then looked up in the analyzed plan, before anything is evaluated:
only the marts, views of this module and constants may be read.
"""

from __future__ import annotations

import re

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from vitrine.plans.marts import Marts, customer_mart_columns, sales_daily, sales_enriched
from vitrine.schemas import (
    CUSTOMERS_MART, CUSTOMERS_SCHEMA, GOLD_TABLES, PRICING_MART, PRICING_SCHEMA, SALES_MART, SALES_SCHEMA,
)

# view name -> (attribute of ``Marts``, schema it has in the warehouse)
MART_VIEWS = {
    SALES_MART: ("sales", SALES_SCHEMA),
    CUSTOMERS_MART: ("customers", CUSTOMERS_SCHEMA),
    PRICING_MART: ("pricing", PRICING_SCHEMA),
}
_QUERY_PREFIX = re.compile(r"^\s*(SELECT|WITH)\b", re.IGNORECASE)
_TRAILING_SEMICOLONS = re.compile(r"[\s;]+$")
_QUOTED_OR_COMMENT = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*|/\*.*?\*/"
_QUALIFIED = re.compile("|".join(
    [f"(?P<other>{_QUOTED_OR_COMMENT})",
     *(rf"(?<![\w.`])`?{schema}`?\s*\.\s*(?P<m{k}>`?{view}`?)(?![\w`])"
       for k, (view, (_, schema)) in enumerate(MART_VIEWS.items()))]), re.IGNORECASE | re.DOTALL)
_SAFE_LEAVES = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef"}
_WITH_A_PLAN = {"ScalarSubquery", "LateralSubquery", "Exists", "ListQuery", "FunctionTableSubqueryArgumentExpression"}
# functions that come with Spark, but call into the JVM or read files by path
_REFUSED_FUNCTIONS = {"reflect", "java_method", "try_reflect", "from_protobuf", "to_protobuf", "from_avro", "to_avro",
                      "schema_of_avro", "python_worker_logs"}
_FUNCTION_NODES = {"UnresolvedFunction": "nameParts", "UnresolvedTableValuedFunction": "name",
                   "UnresolvedGenerator": None}
_UNSAFE_EXPRESSIONS = {"CallMethodViaReflection", "TryReflect", "PythonUDF", "PythonUDAF", "ScalaUDF",
                       "ScalaAggregator", "HiveGenericUDF", "HiveSimpleUDF"}


class ReadOnlyViolation(ValueError):
    """The text is not a single read-only query over the marts."""


def subquery_text(text: str) -> str:
    """The text as one subquery, or raise; also accepted by Spark's grammar."""
    if not _QUERY_PREFIX.match(text):
        raise ReadOnlyViolation("Only SELECT or WITH queries are allowed.")
    return f"SELECT * FROM (\n{_TRAILING_SEMICOLONS.sub('', text)}\n) AS q"


def parsed(spark: SparkSession, text: str):
    """Spark's parse tree of the text as one subquery, or raise."""
    parser = spark._jsparkSession.sessionState().sqlParser()
    try:
        return parser.parsePlan(subquery_text(text))
    except ReadOnlyViolation:
        raise
    except Exception as exc:  # noqa: BLE001 - py4j wraps the parser's error
        raise ReadOnlyViolation(f"Not a single read-only query: {exc}") from exc


def _items(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def _nodes(plan):
    """Every plan node, those of subqueries and named queries included, and every expression.

    A view's own plan is not entered: its name decides.
    """
    stack = [plan]
    while stack:
        node = stack.pop()
        yield node
        name = node.getClass().getSimpleName()
        if name != "View":
            stack.extend(_items(node.children()))
            if hasattr(node, "expressions") and callable(getattr(node, "expressions")):
                try:
                    stack.extend(_items(node.expressions()))
                except Exception:  # noqa: BLE001 - an expression has no expressions()
                    pass
            if name == "UnresolvedWith":
                stack.extend(_items(node.innerChildren()))
            elif name in _WITH_A_PLAN:
                stack.append(node.plan())


def function_names(plan) -> list[tuple[bool, list[str]]]:
    """(whether it makes a table, name in its parts) of the functions named in a parse tree."""
    found = []
    for node in _nodes(plan):
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedGenerator":
            found.append((True, node.name().unquotedString().lower().split(".")))
        elif kind in _FUNCTION_NODES:
            parts = getattr(node, _FUNCTION_NODES[kind])()
            found.append((kind != "UnresolvedFunction", [str(p).lower() for p in _items(parts)]))
    return found


def _is_spark_own(spark: SparkSession, name: str, makes_table: bool) -> bool:
    """Whether Spark brings the function and the session still has Spark's own under the name."""
    analysis = spark._jvm.org.apache.spark.sql.catalyst.analysis
    wanted, state = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name), spark._jsparkSession.sessionState()
    own, session = analysis.FunctionRegistry.builtin(), state.functionRegistry()
    tables = analysis.TableFunctionRegistry.builtin()
    if makes_table and tables.lookupFunction(wanted).isDefined():     # LATERAL VIEW takes generators of either kind
        own, session = tables, state.tableFunctionRegistry()
    mine, now = own.lookupFunction(wanted), session.lookupFunction(wanted)
    return mine.isDefined() and now.isDefined() and mine.get().getClassName() == now.get().getClassName()


def check_functions(spark: SparkSession, plan) -> None:
    """Raise unless every function in the parse tree is Spark's own and not one of the refused."""
    for makes_table, parts in function_names(plan):
        name = parts[-1]
        if len(parts) > 1 or name in _REFUSED_FUNCTIONS or not _is_spark_own(spark, name, makes_table):
            raise ReadOnlyViolation(f"Function not allowed: {'.'.join(parts)}")


def check_analyzed(plan, allowed: set[str]) -> None:
    """Raise unless the analyzed plan reads only ``allowed`` names and calls nothing outside SQL."""
    for node in _nodes(plan):
        name = node.getClass().getSimpleName()
        if name in _UNSAFE_EXPRESSIONS or "Reflect" in name:
            raise ReadOnlyViolation(f"Function not allowed: {name}")
        if name == "View":
            if node.desc().identifier().table().lower() not in allowed:
                raise ReadOnlyViolation(f"Not a mart: {node.desc().identifier().table()}")
        elif name == "LogicalRelation":
            table = node.catalogTable()
            full = table.get().identifier().unquotedString().lower() if table.isDefined() else None
            if full is None or ".".join(full.split(".")[-2:]) not in allowed:
                raise ReadOnlyViolation(f"Not a mart: {full or 'files'}")
        elif not hasattr(node, "dataType") and node.children().isEmpty() and name not in _SAFE_LEAVES \
                and hasattr(node, "output") and not _is_expression(node):
            raise ReadOnlyViolation(f"Not a mart: {name}")


def _is_expression(node) -> bool:
    return ".catalyst.expressions." in node.getClass().getName()


def sql_readonly(spark: SparkSession, text: str, allowed: set[str] | None = None) -> DataFrame:
    """Plan ``text`` as a query and return its (lazy) DataFrame, or raise.

    ``allowed`` names the relations it may read (lower case; default: the marts'
    views and their loaded tables).
    """
    if allowed is None:
        allowed = set(MART_VIEWS) | {f"{schema}.{view}" for view, (_, schema) in MART_VIEWS.items()}
    tree = parsed(spark, text)
    check_functions(spark, tree)
    # names of two or more parts (files, other schemas) are refused before they are looked up
    for name in _relations(tree):
        if len(name) > 1 and ".".join(name[-2:]) not in allowed:
            raise ReadOnlyViolation(f"Not a mart: {'.'.join(name)}")
    try:
        df = spark.sql(subquery_text(text))
    except ParseException as exc:
        raise ReadOnlyViolation(f"Not a single read-only query: {exc}") from exc
    check_analyzed(df._jdf.queryExecution().analyzed(), allowed)
    return df


def local_names(text: str) -> str:
    """The text with schema-qualified mart names as the marts' view names.

    Quoted text and comments stay as they are.
    """
    def plain(match: re.Match) -> str:
        return next((g for key, g in match.groupdict().items() if g and key != "other"), match.group())

    return _QUALIFIED.sub(plain, text)


def _relations(plan) -> list[list[str]]:
    """Names of the relations in a parse tree, in lower case."""
    return [[str(part).lower() for part in _items(node.multipartIdentifier())]
            for node in _nodes(plan) if node.getClass().getSimpleName() == "UnresolvedRelation"]


def named_marts(spark: SparkSession, text: str) -> set[str]:
    """View names of the marts that the text reads (by Spark's parse tree)."""
    return {name[-1] for name in _relations(parsed(spark, text))} & set(MART_VIEWS)


def register_marts(marts: Marts, names: dict[str, str] | set[str] | None = None) -> dict[str, str]:
    """Expose marts to SQL as temporary views (single-part names).

    ``names`` is a set of view names, or a mapping of ``Marts`` attributes to view
    names; by default all three marts. Only the marts named are built.
    """
    if names is None or isinstance(names, set):
        names = {attr: view for view, (attr, _) in MART_VIEWS.items() if names is None or view in names}
    for attr, view in names.items():
        getattr(marts, attr).createOrReplaceTempView(view)
    return names


def local_query(spark: SparkSession, marts: Marts, text: str) -> DataFrame:
    """A read-only query over local marts, by their names or the warehouse's qualified names.

    Registers only the marts that the text names.
    """
    text = local_names(text)
    register_marts(marts, named_marts(spark, text))
    return sql_readonly(spark, text, set(MART_VIEWS))


_CATALOG = "mart string, posicao int, coluna string, tipo string, anulavel boolean"
_READ_AS = {"STRING": "string", "CHAR": "string", "VARCHAR": "string", "SMALLINT": "smallint|int", "INT": "int",
            "DATE": "date"}


def declared_catalog(spark: SparkSession, source) -> DataFrame:
    """The catalog of loaded tables or a warehouse, from their metadata; starts no job.

    Columns are in the contract's order, others follow. The type is the contract's where the source's
    type stands for it (drivers give SMALLINT as int, CHAR as string), else the source's own.
    """
    rows = []
    for name, (mart, schema) in {"sales": (SALES_MART, SALES_SCHEMA), "customers": (CUSTOMERS_MART, CUSTOMERS_SCHEMA),
                                 "pricing": (PRICING_MART, PRICING_SCHEMA)}.items():
        contract = GOLD_TABLES[f"{schema}.{mart}"]
        there = {f.name.lower(): f.dataType.simpleString() for f in source.schema(name).fields}
        declared = dict(contract["columns"])
        ordered = [c for c in declared if c in there] + [c for c in there if c not in declared]
        for pos, column in enumerate(ordered, start=1):
            kind, own = declared.get(column), there[column]
            expected = _READ_AS.get(kind.split("(")[0], kind.lower()).split("|") if kind else []
            rows.append((mart, pos, column, kind.lower() if own.split("(")[0] in expected or own in expected else own,
                         column != contract["key"]))
    return spark.createDataFrame(rows, _CATALOG)


def mart_catalog(spark: SparkSession, marts) -> DataFrame:
    """Name, position, column and type of every mart column; starts no job.

    ``marts`` is a ``Marts``, or a ``MartSource`` of any mode.
    """
    if getattr(marts, "mode", "local") != "local":
        return declared_catalog(spark, marts)
    marts = getattr(marts, "marts", marts)
    sales = sales_enriched(marts.raw).schema.fields
    if marts.with_daily_context:
        sales = [*sales, *(f for f in sales_daily(marts.raw).schema.fields if f.name != "data_venda")]
    rows = [(mart, pos, field.name, field.dataType.simpleString(), field.nullable)
            for mart, fields in ((SALES_MART, sales),
                                 (CUSTOMERS_MART, customer_mart_columns(marts.raw).schema.fields),
                                 (PRICING_MART, marts.pricing.schema.fields))
            for pos, field in enumerate(fields, start=1)]
    return spark.createDataFrame(rows, _CATALOG)
