"""Where the marts are read from: a JDBC warehouse, or built locally.

The dashboard and the report ran SQL either against the warehouse (when a URL
was configured) or against marts computed from the raw files. ``MartSource``
keeps that switch in one place.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.plans.marts import Marts
from vitrine.plans.readonly import local_query, parsed, register_marts, sql_readonly
from vitrine.schemas import (
    CUSTOMERS_MART, CUSTOMERS_SCHEMA, PRICING_MART, PRICING_SCHEMA, SALES_MART, SALES_SCHEMA,
)

MART_TABLES = {
    "sales": f"{SALES_SCHEMA}.{SALES_MART}",
    "customers": f"{CUSTOMERS_SCHEMA}.{CUSTOMERS_MART}",
    "pricing": f"{PRICING_SCHEMA}.{PRICING_MART}",
}
# columns of few values that a warehouse read is split by
SPLIT_COLUMNS = {"sales": ("ano_venda", "mes_venda"), "customers": ("estado",), "pricing": ("categoria",)}
MAX_TASKS = 200            # connections of a split read
MAX_VALUES = 10_000        # combinations of split values that the driver takes


def _literal(value) -> str:
    """The value in SQL that every JDBC driver reads."""
    if isinstance(value, bool) or not isinstance(value, (int, Decimal, str, dt.date)):
        raise TypeError(f"a warehouse read cannot be split by values like {value!r}")
    if isinstance(value, dt.datetime):
        return f"{{ts '{value.isoformat(' ')}'}}"
    if isinstance(value, dt.date):
        return f"{{d '{value.isoformat()}'}}"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def split_predicates(columns: tuple[str, ...], values: list[tuple], tasks: int = MAX_TASKS) -> list[str]:
    """At most ``tasks`` conditions of which every row with one of the values meets exactly one."""
    def one(row: tuple) -> str:
        return " AND ".join(f"{c} IS NULL" if v is None else f"{c} = {_literal(v)}"
                            for c, v in zip(columns, row))

    rows = sorted(set(values), key=lambda r: [(v is not None, v) if v is not None else (False,) for v in r])
    each = max(1, -(-len(rows) // tasks))
    return [" OR ".join(f"({one(r)})" for r in rows[k:k + each]) for k in range(0, len(rows), each)]


class MartSource:
    """``query(sql)`` and ``mart(name)`` over a JDBC warehouse, the loaded gold
    tables, or marts built from the raw files.

    * ``jdbc_url``: the SQL runs in the warehouse and Spark reads the result. Whole marts are
      read by many tasks, one connection each, split by ``SPLIT_COLUMNS`` (sales by month);
      a query is split by the columns of its result given as ``split_by``. The split values are
      asked for first, so a load that commits in between can be seen by some tasks only;
    * ``catalog=True``: the gold tables loaded by ``vitrine.sources.tables``
      are read from the session catalog under their schema-qualified names;
      filters on ``ano_venda``/``mes_venda`` prune the sales table's partitions;
    * ``marts``: the SQL runs in Spark over the lazily built marts, under their
      single-part names or the warehouse's qualified names.

    It has the attributes of ``Marts`` that the report and the pages read (``sales``,
    ``sales_facts``, ``customers``, ``pricing`` ...), so it stands in for one.
    """

    READ_ONLY_SESSION = "SET default_transaction_read_only = on"

    def __init__(self, spark: SparkSession, marts: Marts | None = None,
                 jdbc_url: str | None = None, jdbc_options: dict | None = None,
                 catalog: bool = False):
        if marts is None and not jdbc_url and not catalog:
            raise ValueError("give local marts, a JDBC URL or catalog=True")
        self.spark, self.marts, self.catalog = spark, marts, catalog
        self.jdbc_url, self.jdbc_options = jdbc_url, dict(jdbc_options or {})

    @property
    def mode(self) -> str:
        return "jdbc" if self.jdbc_url else ("catalog" if self.catalog else "local")

    def query(self, sql: str, split_by: tuple[str, ...] = ()) -> DataFrame:
        """Run the text as it is (see :meth:`query_readonly` for text of others)."""
        if self.jdbc_url:
            return self._read(sql, split_by, self._jdbc())
        if self.mode == "local":
            register_marts(self.marts)
        return self.spark.sql(sql)

    def query_readonly(self, sql: str, split_by: tuple[str, ...] = ()) -> DataFrame:
        """Like :meth:`query`, but only a single read-only query over the marts is accepted.

        In Spark the functions it names and its analyzed plan are checked (see ``sql_readonly``). Over
        JDBC the text must parse as one subquery in Spark's grammar, since Spark pastes it between
        parentheses; for PostgreSQL the session is read-only besides.
        """
        if self.jdbc_url:
            parsed(self.spark, sql)
            reader = self._jdbc()
            if self.jdbc_url.startswith("jdbc:postgresql"):
                reader = reader.option("sessionInitStatement", self.READ_ONLY_SESSION)
            return self._read(sql.rstrip().rstrip("; \n\t"), split_by, reader)
        if self.mode == "local":
            return local_query(self.spark, self.marts, sql)
        return sql_readonly(self.spark, sql)

    def _read(self, sql: str, split_by: tuple[str, ...], reader) -> DataFrame:
        if split_by:
            return self._split(f"(\n{sql}\n) q", tuple(split_by), reader)
        return reader.option("query", sql).load()

    def _split(self, relation: str, columns: tuple[str, ...], reader) -> DataFrame:
        """The relation's rows, read by one task per group of values of ``columns``."""
        names = ", ".join(columns)
        values = [tuple(r) for r in self._jdbc().option("dbtable", f"(SELECT DISTINCT {names} FROM {relation}) v")
                  .load().limit(MAX_VALUES + 1).collect()]
        if len(values) > MAX_VALUES:
            raise ValueError(f"more than {MAX_VALUES} values of {names}; split by columns of fewer values")
        predicates = split_predicates(columns, values)
        if not predicates:
            return reader.option("dbtable", relation).load()
        return reader.jdbc(self.jdbc_url, relation, predicates=predicates)

    def _jdbc(self):
        return self.spark.read.format("jdbc").option("url", self.jdbc_url).options(**self.jdbc_options)

    # -- what stands in for ``Marts``: remote marts hold every column, so the lean forms are them
    def _form(self, attribute: str, mart: str) -> DataFrame:
        return getattr(self.marts, attribute) if self.mode == "local" else self.mart(mart)

    sales = property(lambda self: self._form("sales", "sales"))
    sales_facts = property(lambda self: self._form("sales_facts", "sales"))
    sales_with_products = property(lambda self: self._form("sales_with_products", "sales"))
    customers = property(lambda self: self._form("customers", "customers"))
    customer_segments = property(lambda self: self._form("customer_segments", "customers"))
    customer_base = property(lambda self: self._form("customer_base", "customers"))
    pricing = property(lambda self: self._form("pricing", "pricing"))

    def persist(self, *names: str) -> "MartSource":
        """Keep local marts (see ``Marts.persist``); loaded tables are read again instead."""
        if self.mode == "local":
            self.marts.persist(*names)
        return self

    def is_persisted(self, name: str) -> bool:
        return self.mode != "local" or self.marts.is_persisted(name)

    def unpersist(self, *names: str) -> None:
        if self.mode == "local":
            self.marts.unpersist(*names)

    def mart(self, name: str, order_by_rank: bool = False) -> DataFrame:
        """Whole mart (``SELECT *``); customers optionally by rank, NULLs last."""
        if self.jdbc_url:
            df = self._split(MART_TABLES[name], SPLIT_COLUMNS[name], self._jdbc())
            df = df.toDF(*[c.lower() for c in df.columns])
        elif self.catalog:
            df = self.spark.table(MART_TABLES[name])
        else:
            df = getattr(self.marts, name)
        if order_by_rank:
            df = df.orderBy(F.col("ranking_receita").asc_nulls_last())
        return df

    def schema(self, name: str):
        """Columns of a mart as its source declares them; reads no row."""
        if self.jdbc_url:
            return self._jdbc().option("dbtable", MART_TABLES[name]).load().schema
        return self.spark.table(MART_TABLES[name]).schema if self.catalog else getattr(self.marts, name).schema
