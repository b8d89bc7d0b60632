"""Read-only SQL guard corpus and the mart catalog."""

from __future__ import annotations

import os

import pytest

from tests.fixtures import customer, product, raw, sale
from vitrine.plans.marts import build_marts
from vitrine.plans.readonly import (
    ReadOnlyViolation, local_names, mart_catalog, named_marts, register_marts, sql_readonly,
)
from vitrine.sources.warehouse import MartSource


@pytest.fixture
def registered(spark):
    r = raw(spark, vendas=[sale(1, "2024-01-01 10:00:00", cliente="a"),
                           sale(2, "2024-01-01 11:00:00", cliente="b", canal=None)],
            clientes=[customer("a"), customer("b")], produtos=[product("p1")])
    marts = build_marts(r)
    register_marts(marts)
    spark.createDataFrame([(1,)], "x int").createOrReplaceTempView("guard_target")
    return marts


ALLOWED = [
    "SELECT COUNT(*) AS n FROM vendas_temporais",
    "  select segmento_cliente, count(*) from clientes_segmentacao group by 1",
    "WITH t AS (SELECT * FROM vendas_temporais) SELECT COUNT(*) FROM t",
    "SELECT 1 AS x -- trailing comment",
    "SELECT 1 AS x;",
    "SELECT canal_venda, COUNT(*) AS n FROM vendas_temporais GROUP BY canal_venda",
    "SELECT * FROM range(3) r JOIN (VALUES (1), (2)) AS v(x) ON r.id = v.x",
    "SELECT * FROM vendas_temporais v WHERE EXISTS "
    "(SELECT 1 FROM clientes_segmentacao c WHERE c.id_cliente = v.id_cliente)",
    "SELECT (SELECT MAX(receita_total) FROM clientes_segmentacao) AS x",
    "SELECT segmento_cliente, RANK() OVER (ORDER BY receita_total) AS r FROM clientes_segmentacao",
]

REFLECT = "reflect('java.lang.System', 'setProperty', 'vitrine.guard', 'set')"
REFUSED = [
    "INSERT INTO guard_target VALUES (2)",
    "DROP VIEW guard_target",
    "WITH t AS (SELECT 1 AS x) INSERT INTO guard_target SELECT x FROM t",
    "FROM guard_target INSERT INTO guard_target SELECT x",
    "SELECT 1; DROP VIEW guard_target",
    "SELECT 1) AS q; DROP VIEW guard_target; SELECT * FROM (SELECT 1",
    "CREATE TABLE t2 AS SELECT 1",
    "SET spark.sql.ansi.enabled=false",
    "CACHE TABLE guard_target",
    "WITH t AS (SELECT 1) DELETE FROM guard_target",
    # queries by grammar, but not over the marts alone
    f"SELECT {REFLECT}",
    f"SELECT java_method('java.lang.System', 'setProperty', 'vitrine.guard', 'set')",
    f"SELECT try_reflect('java.lang.System', 'setProperty', 'vitrine.guard', 'set')",
    f"WITH t AS (SELECT {REFLECT} AS x) SELECT * FROM t",
    f"SELECT (SELECT {REFLECT} FROM vendas_temporais LIMIT 1) AS x",
    f"SELECT 1 FROM vendas_temporais WHERE id_venda IN (SELECT {REFLECT})",
    f"SELECT 1 FROM vendas_temporais ORDER BY {REFLECT}",
    f"SELECT 1 FROM vendas_temporais v WHERE EXISTS (SELECT 1 WHERE {REFLECT} = v.id_venda)",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`",
    "SELECT 1 WHERE EXISTS (SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`)",
    "SELECT * FROM guard_target",
    "SELECT * FROM vendas_temporais WHERE EXISTS (SELECT 1 FROM guard_target)",
    "SELECT 1 UNION ALL SELECT x FROM guard_target",
]


FUNCTIONS = [
    "SELECT upper(canal_venda), coalesce(canal_venda, '-') FROM vendas_temporais",
    "SELECT e FROM vendas_temporais LATERAL VIEW explode(array(1, 2)) t AS e",
    "SELECT k FROM vendas_temporais LATERAL VIEW OUTER posexplode(array(id_cliente)) t AS p, k",
    "SELECT * FROM vendas_temporais v, LATERAL explode(array(1, 2)) AS t(e)",
    "SELECT * FROM explode(sequence(1, 3)) AS t(e)",
    "SELECT transform(array(1, 2), x -> x + 1), aggregate(array(1), 0, (a, b) -> a + b) FROM vendas_temporais",
    "SELECT data_venda, SUM(receita_total) FILTER (WHERE hora_venda > 3), COUNT(DISTINCT id_cliente), "
    "PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY receita_total) FROM vendas_temporais GROUP BY data_venda",
    "SELECT date_trunc('month', data_venda), CASE WHEN id_venda LIKE '1%' THEN 1 END, CAST(hora_venda AS STRING), "
    "id_venda || 'x', EXTRACT(YEAR FROM data_venda), id_cliente IN ('a') FROM vendas_temporais",
    "SELECT LAG(receita_total) OVER (PARTITION BY id_cliente ORDER BY data_venda), ROUND(receita_total, 1) FROM "
    "vendas_temporais",
    "SELECT to_json(named_struct('a', id_venda)), regexp_extract(id_venda, '[0-9]+', 0) FROM vendas_temporais",
]


@pytest.fixture
def foreign(spark, registered, scratch):
    """Functions that are not Spark's: of Python, of Python for tables, of SQL, of the JVM."""
    from pyspark.sql.functions import udtf

    mark = f"{scratch}/written"

    @udtf(returnType="x int")
    class Side:
        def eval(self):
            open(mark, "w").close()
            yield 1,

    @udtf
    class Planned:                              # its analysis runs Python while a query is planned
        @staticmethod
        def analyze():
            from pyspark.sql.types import IntegerType, StructType
            from pyspark.sql.udtf import AnalyzeResult
            open(mark, "w").close()
            return AnalyzeResult(StructType().add("x", IntegerType()))

        def eval(self):
            yield 1,

    spark.udtf.register("side", Side)
    spark.udtf.register("planned", Planned)
    spark.udf.register("py_f", lambda x: x)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION sql_f(x INT) RETURNS INT RETURN x + 1")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION jvm_f AS 'org.apache.hadoop.hive.ql.udf.UDFPI'")
    yield mark
    for name in ("side", "planned", "py_f", "sql_f", "jvm_f"):
        spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")


FOREIGN = [
    "SELECT * FROM side()", "SELECT * FROM vendas_temporais, LATERAL side()", "SELECT * FROM planned()",
    "WITH t AS (SELECT * FROM side()) SELECT * FROM t", "SELECT (SELECT MAX(x) FROM side())",
    "SELECT 1 WHERE EXISTS (SELECT * FROM planned())",
    "SELECT py_f(id_venda) FROM vendas_temporais", "SELECT sql_f(1)", "SELECT jvm_f()",
    "SELECT 1 FROM vendas_temporais ORDER BY py_f(id_venda)", "SELECT transform(array(1), x -> sql_f(x))",
    "SELECT spark_catalog.default.f(1)", "SELECT no_such_function(1)", "SELECT * FROM no_such_table_function()",
    "SELECT e FROM vendas_temporais LATERAL VIEW py_f(id_venda) t AS e",
    "SELECT from_protobuf(binary(id_venda), 'm', '/etc/passwd') FROM vendas_temporais",
    "SELECT * FROM python_worker_logs()",
]


@pytest.mark.parametrize("text", FUNCTIONS)
def test_functions_of_spark_pass(spark, registered, text):
    assert sql_readonly(spark, text).collect() is not None


@pytest.mark.parametrize("text", FOREIGN)
def test_other_functions_are_refused_before_they_run(spark, foreign, text):
    with pytest.raises(ReadOnlyViolation, match="Function not allowed"):
        sql_readonly(spark, text)
    assert not os.path.exists(foreign)


def test_a_replaced_function_is_refused(spark):
    other = spark.newSession()
    assert sql_readonly(other, "SELECT upper('x') AS x").first().x == "X"
    other.udf.register("upper", lambda x: "replaced")
    with pytest.raises(ReadOnlyViolation, match="upper"):
        sql_readonly(other, "SELECT upper('x') AS x")


@pytest.mark.parametrize("text", ALLOWED)
def test_queries_pass(spark, registered, text):
    assert sql_readonly(spark, text).collect() is not None


@pytest.mark.parametrize("text", REFUSED)
def test_other_statements_are_refused_without_effect(spark, registered, text):
    with pytest.raises(ReadOnlyViolation):
        sql_readonly(spark, text)
    assert spark.table("guard_target").collect()[0].x == 1
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    assert spark._jvm.System.getProperty("vitrine.guard") is None


def test_sql_groups_keep_null_keys(spark, registered):
    rows = sql_readonly(spark, "SELECT canal_venda, COUNT(*) AS n FROM vendas_temporais "
                               "GROUP BY canal_venda").collect()
    assert {r.canal_venda for r in rows} == {"site", None}


# the shapes of text that the report and the pages send, with the warehouse's names
QUALIFIED = [
    "SELECT data_venda, SUM(receita_total) AS receita FROM public_gold_sales.vendas_temporais "
    "GROUP BY data_venda ORDER BY data_venda DESC LIMIT 7",
    "SELECT segmento_cliente, COUNT(*) AS n FROM public_gold_cs.clientes_segmentacao GROUP BY 1",
    "SELECT classificacao_preco, COUNT(*) AS n FROM `public_gold_pricing`.`precos_competitividade` "
    "GROUP BY classificacao_preco",
    "SELECT nome_produto FROM PUBLIC_GOLD_PRICING . precos_competitividade p WHERE "
    "p.classificacao_preco = 'public_gold_sales.vendas_temporais'",
]


@pytest.mark.parametrize("text", QUALIFIED)
def test_qualified_names_over_local_marts(spark, registered, text):
    assert MartSource(spark, marts=registered).query_readonly(text).collect() is not None


def test_names_in_quotes_and_comments_stay():
    text = "SELECT 'public_gold_cs.clientes_segmentacao' AS x -- public_gold_cs.clientes_segmentacao\n" \
           "FROM public_gold_cs.clientes_segmentacao"
    assert local_names(text) == text.replace("FROM public_gold_cs.", "FROM ")
    assert local_names("SELECT 1 FROM my_public_gold_cs.clientes_segmentacao") == \
        "SELECT 1 FROM my_public_gold_cs.clientes_segmentacao"


def _jobs_of(spark, action):
    group = f"jobs-{id(action)}"
    spark.sparkContext.setJobGroup(group, "test")
    action()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("other", "test")
    return jobs


def test_only_named_marts_are_built(spark, registered):
    fresh = build_marts(registered.raw)
    MartSource(spark, marts=fresh).query_readonly("SELECT COUNT(*) AS n FROM vendas_temporais")
    assert "sales" in vars(fresh) and "customers" not in vars(fresh) and "pricing" not in vars(fresh)
    assert named_marts(spark, "WITH t AS (SELECT * FROM public_gold_cs.clientes_segmentacao) SELECT "
                              "(SELECT 1 FROM precos_competitividade) FROM t, other") == {
        "clientes_segmentacao", "precos_competitividade"}


def test_catalog_starts_no_job(spark, registered):
    for context in (False, True):
        marts = build_marts(registered.raw, context)
        assert _jobs_of(spark, lambda m=marts: mart_catalog(spark, m)) == 0
        fields = [(f.name, f.dataType.simpleString()) for f in marts.sales.schema.fields]
        listed = [(r.coluna, r.tipo) for r in mart_catalog(spark, marts)
                  .where("mart = 'vendas_temporais'").orderBy("posicao").collect()]
        assert sorted(listed) == sorted(fields)


@pytest.mark.parametrize("text", [
    "SELECTX 1", "WITHDRAW 1", "SELECT 1) x; DROP TABLE t; SELECT * FROM (SELECT 1", "SELECT 1; SELECT 2",
    "WITH t AS (SELECT 1) DELETE FROM u"])
def test_jdbc_text_is_parsed_before_it_is_sent(spark, text):
    source = MartSource(spark, jdbc_url="jdbc:none:never-connected")
    with pytest.raises(ReadOnlyViolation):
        source.query_readonly(text)


def test_mart_catalog(spark, registered):
    cat = {(r.mart, r.coluna): r.tipo for r in mart_catalog(spark, registered).collect()}
    assert cat[("vendas_temporais", "receita_total")] == "decimal(38,2)"
    assert cat[("clientes_segmentacao", "ranking_receita")] == "bigint"
    assert cat[("precos_competitividade", "classificacao_preco")] == "string"
    assert len({m for m, _ in cat}) == 3
