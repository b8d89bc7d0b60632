"""Tiny raw tables whose answers are worked out by hand (FIXTURES.md §3)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from vitrine.schemas import RAW_CLIENTES, RAW_PRECOS, RAW_PRODUTOS, RAW_VENDAS
from vitrine.sources.raw import RawTables


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def raw(spark, vendas=(), clientes=(), produtos=(), precos=()) -> RawTables:
    return RawTables(
        vendas=spark.createDataFrame(list(vendas), RAW_VENDAS),
        clientes=spark.createDataFrame(list(clientes), RAW_CLIENTES),
        produtos=spark.createDataFrame(list(produtos), RAW_PRODUTOS),
        preco_competidores=spark.createDataFrame(list(precos), RAW_PRECOS),
    )


def sale(i, when, cliente="c1", produto="p1", qty=1, price="10.00", canal="site"):
    return (str(i), ts(when), canal, cliente, produto, qty, D(price))


def customer(i, nome=None, estado="SP", pais="Brasil", cadastro=dt.date(2024, 1, 1)):
    return (i, nome or f"Cliente {i}", estado, pais, cadastro)


def product(i, price="10.00", categoria="cat", marca="m", nome=None):
    return (i, nome or f"Produto {i}", categoria, marca, D(price))


def obs(produto, concorrente, price, when):
    return (produto, concorrente, D(price), ts(when))
