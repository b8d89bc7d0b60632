"""Map the driver's TPC-H-like tables onto the four raw retail relations.

The rules (see FIXTURES.md §2) are deterministic column expressions, and every row
of the source tables becomes a row. The driver tables have no orphan sale, no
customer without sales and no product without sales or competitor price, and the
marts have a NULL branch for each; so some keys are written differently on one side
of a relation, which leaves the row in place and its key without a match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.schemas import PRICE
from vitrine.sources.raw import RawTables

# Fixed values of the mapping (FIXTURES.md §2.1): the keys with this remainder are
# written with a prefix, so that they have no match on the other side.
SALE_CUSTOMER_UNKNOWN = (50, 7)    # sales of customers with o_custkey % 50 = 7
SALE_PRODUCT_UNKNOWN = (25, 4)     # sales of parts with l_partkey % 25 = 4
CUSTOMER_UNSEEN = (100, 13)        # customers with c_custkey % 100 = 13
PRODUCT_UNSEEN = (100, 17)         # products with p_partkey % 100 = 17
PRICE_UNKNOWN = (20, 3)            # price observations of l_partkey % 20 = 3
UNKNOWN_PREFIX = "X"               # in sales and price observations
UNSEEN_PREFIX = "N"                # in customers and products
COUNTRY = "Brasil"
SIGNUP_EPOCH = "2020-01-01"
COMPETITOR_PREFIX = "Concorrente_"


# Column types of the driver tables that the mapping reads (TESTDATA.md).
DRIVER_TYPES = {
    "lineitem": {"l_orderkey": T.LongType(), "l_partkey": T.LongType(), "l_suppkey": T.LongType(),
                 "l_linenumber": T.IntegerType(), "l_quantity": T.DoubleType(),
                 "l_extendedprice": T.DoubleType(), "l_shipdate": T.TimestampNTZType()},
    "orders": {"o_orderkey": T.LongType(), "o_custkey": T.LongType(),
               "o_orderdate": T.TimestampNTZType(), "o_orderpriority": T.StringType()},
    "customer": {"c_custkey": T.LongType(), "c_name": T.StringType(), "c_nationkey": T.IntegerType()},
    "nation": {"n_nationkey": T.IntegerType()},
    "part": {"p_partkey": T.LongType(), "p_name": T.StringType(), "p_brand": T.StringType(),
             "p_type": T.StringType(), "p_retailprice": T.DoubleType()},
}


def _key(key: Column, apart: tuple[int, int], prefix: str) -> Column:
    """The key as text, with ``prefix`` where its remainder sets it apart."""
    text = key.cast("string")
    return F.when(key % apart[0] == apart[1], F.concat(F.lit(prefix), text)).otherwise(text)


def _table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    types = DRIVER_TYPES[name]
    schema = T.StructType([T.StructField(c, types[c]) for c in cols])
    return spark.read.schema(schema).parquet(f"{sf_dir}/{name}.parquet")


def map_vendas(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    li, od = lineitem, orders
    hour = ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 5) % 24).cast("int")
    return (
        li.join(od, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.concat_ws("-", F.col("l_orderkey").cast("string"),
                        F.col("l_linenumber").cast("string")).alias("id_venda"),
            (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), hour, F.lit(0), F.lit(0)))
            .alias("data_venda"),
            F.col("o_orderpriority").alias("canal_venda"),
            _key(F.col("o_custkey"), SALE_CUSTOMER_UNKNOWN, UNKNOWN_PREFIX).alias("id_cliente"),
            _key(F.col("l_partkey"), SALE_PRODUCT_UNKNOWN, UNKNOWN_PREFIX).alias("id_produto"),
            F.col("l_quantity").cast("int").alias("quantidade"),
            F.col("l_extendedprice").cast(PRICE).alias("preco_unitario"),
        )
    )


def map_clientes(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Customers of a known nation. Only customer columns are used, so the join
    with the (unique-keyed) nation table is a semi join: same rows, and the
    planner's size estimate stays that of the customer table."""
    key = F.col("c_nationkey")
    estado = F.when(key < 10, F.concat(F.lit("N"), key.cast("string"))).otherwise(key.cast("string"))
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
        .select(
            _key(F.col("c_custkey"), CUSTOMER_UNSEEN, UNSEEN_PREFIX).alias("id_cliente"),
            F.col("c_name").alias("nome_cliente"),
            estado.alias("estado"),
            F.lit(COUNTRY).alias("pais"),
            F.date_add(F.lit(SIGNUP_EPOCH).cast("date"), (F.col("c_custkey") % 365).cast("int"))
            .alias("data_cadastro"),
        )
    )


def map_produtos(part: DataFrame) -> DataFrame:
    return part.select(
        _key(F.col("p_partkey"), PRODUCT_UNSEEN, UNSEEN_PREFIX).alias("id_produto"),
        F.col("p_name").alias("nome_produto"),
        F.col("p_type").alias("categoria"),
        F.col("p_brand").alias("marca"),
        F.col("p_retailprice").cast(PRICE).alias("preco_atual"),
    )


def map_precos(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """One competitor price observation per line item of a known part."""
    pk, sk = F.col("l_partkey"), F.col("l_suppkey")
    shift = ((pk % 7) - 3) * 4 + (sk * 7 + F.col("l_linenumber") * 3 + F.col("l_orderkey")) % 13 - 6
    base = F.col("p_retailprice").cast(PRICE)
    price = F.when(pk % 11 == 0, base).otherwise(base + shift * 9).cast(PRICE)
    return (
        lineitem.join(part, pk == F.col("p_partkey"))
        .select(
            _key(pk, PRICE_UNKNOWN, UNKNOWN_PREFIX).alias("id_produto"),
            F.concat(F.lit(COMPETITOR_PREFIX), (sk % 4).cast("string")).alias("nome_concorrente"),
            price.alias("preco_concorrente"),
            F.col("l_shipdate").alias("data_coleta"),
            F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey"),
        )
    )


def raw_from_testdata(spark: SparkSession, sf_dir: str) -> RawTables:
    """Raw relations derived from ``{sf_dir}/{table}.parquet`` (whole tables)."""
    lineitem = _table(
        spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey",
        "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    orders = _table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate",
                    "o_orderpriority")
    customer = _table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey")
    nation = _table(spark, sf_dir, "nation", "n_nationkey")
    part = _table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type",
                  "p_retailprice")
    return RawTables(
        vendas=map_vendas(lineitem, orders),
        clientes=map_clientes(customer, nation),
        produtos=map_produtos(part),
        preco_competidores=map_precos(lineitem, part),
        price_tiebreak=("l_orderkey", "l_linenumber", "l_suppkey", "preco_concorrente"),
    )
