"""Raw input schemas, gold mart contracts and the fixed domain vocabulary."""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Fixed values. These must equal the reference's labels and numbers exactly;
# they are part of the public contract of the marts and the dashboard.
# --------------------------------------------------------------------------
# Weekday names, Spark dayofweek numbering (1 = Sunday ... 7 = Saturday).
WEEKDAY_NAMES = {
    1: "Domingo", 2: "Segunda", 3: "Terça", 4: "Quarta",
    5: "Quinta", 6: "Sexta", 7: "Sábado",
}
# Dashboard display order of weekdays, Monday first.
WEEKDAY_DISPLAY_ORDER = ["Segunda", "Terça", "Quarta", "Quinta", "Sexta", "Sábado", "Domingo"]
# Short month labels, January first.
MONTH_LABELS = ["Jan", "Fev", "Mar", "Abr", "Mai", "Jun", "Jul", "Ago", "Set", "Out", "Nov", "Dez"]
# Customer segments and the revenue-rank thresholds that define them.
SEGMENT_VIP = "VIP"
SEGMENT_TOP = "TOP_TIER"
SEGMENT_REGULAR = "REGULAR"
VIP_MAX_RANK = 10
TOP_TIER_MAX_RANK = 25
# Price classes, in the order the classification tests them.
CLASS_MORE_EXPENSIVE_THAN_ALL = "MAIS_CARO_QUE_TODOS"
CLASS_ABOVE_AVERAGE = "ACIMA_DA_MEDIA"
CLASS_CHEAPER_THAN_ALL = "MAIS_BARATO_QUE_TODOS"
CLASS_BELOW_AVERAGE = "ABAIXO_DA_MEDIA"
CLASS_AT_AVERAGE = "NA_MEDIA"
# Gold namespaces and mart names.
SALES_SCHEMA, SALES_MART = "public_gold_sales", "vendas_temporais"
CUSTOMERS_SCHEMA, CUSTOMERS_MART = "public_gold_cs", "clientes_segmentacao"
PRICING_SCHEMA, PRICING_MART = "public_gold_pricing", "precos_competitividade"
# Chunk size for long texts (message size limit of the delivery channel).
TEXT_CHUNK_CHARS = 4096
# Report: days shown and critical products listed.
REPORT_LAST_DAYS = 7
REPORT_CRITICAL_PRODUCTS = 10
# Dashboard: categories in the top-categories chart, customers in the top list.
DASHBOARD_TOP_CATEGORIES = 8
DASHBOARD_TOP_CUSTOMERS = 10
# --------------------------------------------------------------------------

PRICE = T.DecimalType(10, 2)          # unit and list prices
MONEY = T.DecimalType(38, 2)          # revenue and money sums

# Raw tables (one Parquet dataset each).
RAW_VENDAS = T.StructType([
    T.StructField("id_venda", T.StringType()),
    T.StructField("data_venda", T.TimestampNTZType()),
    T.StructField("canal_venda", T.StringType()),
    T.StructField("id_cliente", T.StringType()),
    T.StructField("id_produto", T.StringType()),
    T.StructField("quantidade", T.IntegerType()),
    T.StructField("preco_unitario", PRICE),
])
RAW_CLIENTES = T.StructType([
    T.StructField("id_cliente", T.StringType()),
    T.StructField("nome_cliente", T.StringType()),
    T.StructField("estado", T.StringType()),
    T.StructField("pais", T.StringType()),
    T.StructField("data_cadastro", T.DateType()),
])
RAW_PRODUTOS = T.StructType([
    T.StructField("id_produto", T.StringType()),
    T.StructField("nome_produto", T.StringType()),
    T.StructField("categoria", T.StringType()),
    T.StructField("marca", T.StringType()),
    T.StructField("preco_atual", PRICE),
])
RAW_PRECOS = T.StructType([
    T.StructField("id_produto", T.StringType()),
    T.StructField("nome_concorrente", T.StringType()),
    T.StructField("preco_concorrente", PRICE),
    T.StructField("data_coleta", T.TimestampNTZType()),
])
RAW_SCHEMAS = {
    "vendas": RAW_VENDAS,
    "clientes": RAW_CLIENTES,
    "produtos": RAW_PRODUTOS,
    "preco_competidores": RAW_PRECOS,
}

# --------------------------------------------------------------------------
# Fixed values, continued: display names of the dashboard's tables, and the gold
# table contracts (column, SQL type, key) that the warehouse declares.
# --------------------------------------------------------------------------
CUSTOMER_TABLE_NAMES = {
    "ranking_receita": "Rank", "nome_cliente": "Cliente", "estado": "Estado",
    "segmento_cliente": "Segmento", "receita_total": "Receita", "total_compras": "Compras",
    "ticket_medio": "Ticket Médio", "data_cadastro": "Cadastro",
}
PRICE_ALERT_NAMES = {
    "nome_produto": "Produto", "categoria": "Categoria", "nosso_preco": "Nosso Preço",
    "preco_maximo_concorrentes": "Máx. Concorrente", "diferenca_percentual_vs_media": "Dif. %",
    "receita_total": "Receita",
}
# Gold table contracts: (column, SQL type) in table order, and the key.
GOLD_TABLES = {
    f"{SALES_SCHEMA}.{SALES_MART}": {
        "key": "id_venda",
        "partitioned_by": ["ano_venda", "mes_venda"],
        "columns": [
            ("id_venda", "STRING"), ("data_venda", "DATE"),
            ("ano_venda", "SMALLINT"), ("mes_venda", "SMALLINT"), ("hora_venda", "SMALLINT"),
            ("dia_semana_num", "SMALLINT"), ("dia_semana_nome", "VARCHAR(10)"),
            ("canal_venda", "VARCHAR(50)"), ("id_cliente", "STRING"), ("nome_cliente", "STRING"),
            ("estado", "CHAR(2)"), ("id_produto", "STRING"), ("nome_produto", "STRING"),
            ("categoria", "STRING"), ("marca", "STRING"), ("quantidade", "INT"),
            ("preco_unitario", "DECIMAL(10,2)"), ("receita_total", "DECIMAL(12,2)"),
            ("total_vendas", "INT"), ("total_clientes_unicos", "INT"),
            ("ticket_medio", "DECIMAL(10,2)"),
        ],
    },
    f"{CUSTOMERS_SCHEMA}.{CUSTOMERS_MART}": {
        "key": "id_cliente",
        "partitioned_by": [],
        "columns": [
            ("id_cliente", "STRING"), ("nome_cliente", "STRING"), ("estado", "CHAR(2)"),
            ("pais", "VARCHAR(50)"), ("data_cadastro", "DATE"),
            ("receita_total", "DECIMAL(12,2)"), ("total_compras", "INT"),
            ("ticket_medio", "DECIMAL(10,2)"), ("ranking_receita", "INT"),
            ("segmento_cliente", "VARCHAR(20)"),
        ],
    },
    f"{PRICING_SCHEMA}.{PRICING_MART}": {
        "key": "id_produto",
        "partitioned_by": [],
        "columns": [
            ("id_produto", "STRING"), ("nome_produto", "STRING"), ("categoria", "STRING"),
            ("marca", "STRING"), ("nosso_preco", "DECIMAL(10,2)"),
            ("preco_medio_concorrentes", "DECIMAL(10,2)"),
            ("preco_minimo_concorrentes", "DECIMAL(10,2)"),
            ("preco_maximo_concorrentes", "DECIMAL(10,2)"),
            ("qtd_concorrentes", "INT"),
            ("diferenca_percentual_vs_media", "DECIMAL(8,2)"),
            ("classificacao_preco", "VARCHAR(30)"), ("quantidade_total", "INT"),
            ("receita_total", "DECIMAL(12,2)"),
        ],
    },
}
