"""Formatting, calendar labels and text chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import (
    brl, brl_or_dash, month_label, signed_percent, text_chunks, thousands, weekday_order,
)


def _one(spark, expr, value, typ):
    return spark.createDataFrame([(value,)], f"x {typ}").select(expr(F.col("x")).alias("y")).first().y


def test_brl_matches_python_format(spark):
    shown = {0.0: "R$ 0,00", 1234.56: "R$ 1.234,56", 1234567.125: "R$ 1.234.567,12", 2.675: "R$ 2,67",
             0.125: "R$ 0,12", 999999.995: "R$ 999.999,99", 12.5: "R$ 12,50", -1234.5: "R$ -1.234,50"}
    for v, text in shown.items():
        assert _one(spark, brl, v, "double") == text, v
    assert _one(spark, brl, __import__("decimal").Decimal("1234.56"), "decimal(12,2)") == "R$ 1.234,56"


def test_brl_or_dash(spark):
    assert _one(spark, brl_or_dash, None, "double") == "—"


def test_signed_percent_matches_python(spark):
    for v in [0.25, -0.04, 1.25, 12.35, 0.0, -0.0, 3.14159, -12.25]:
        assert _one(spark, signed_percent, v, "double") == f"{v:+.1f}%", v


def test_thousands(spark):
    assert _one(spark, thousands, 1234567, "bigint") == "1,234,567"
    assert _one(spark, thousands, 12, "bigint") == "12"


def test_month_and_weekday_labels(spark):
    df = spark.range(0, 14).select(month_label(F.col("id").cast("int")).alias("m"))
    assert [r.m for r in df.collect()] == [None, "Jan", "Fev", "Mar", "Abr", "Mai", "Jun", "Jul",
                                           "Ago", "Set", "Out", "Nov", "Dez", None]
    assert _one(spark, weekday_order, "Segunda", "string") == 1
    assert _one(spark, weekday_order, "Domingo", "string") == 7
    assert _one(spark, weekday_order, "Feriado", "string") is None


def test_text_chunks_lengths(spark):
    texts = {"empty": "", "one": "a", "full": "b" * 4096, "over": "c" * 4097}
    df = spark.createDataFrame(list(texts.items()), "k string, t string")
    parts = {}
    for r in text_chunks(df, "t").collect():
        parts.setdefault(r.k, []).append((r.parte, len(r.texto)))
    assert "empty" not in parts
    assert parts["one"] == [(0, 1)]
    assert parts["full"] == [(0, 4096)]
    assert sorted(parts["over"]) == [(0, 4096), (1, 1)]


def test_text_chunks_concatenate_to_text(spark):
    text = "".join(chr(0x41 + i % 26) + ("é" if i % 7 == 0 else "") + ("😀" if i % 50 == 0 else "")
                   for i in range(10000))
    df = spark.createDataFrame([(1, text), (2, None)], "k int, t string")
    rows = sorted((r.parte, r.texto) for r in text_chunks(df, "t", size=1000).collect())
    assert "".join(t for _, t in rows) == text
    assert all(len(t) <= 1000 for _, t in rows)
    assert [p for p, _ in rows] == list(range(len(rows)))
    expected = [text[i:i + 1000] for i in range(0, len(text), 1000)]
    assert [t for _, t in rows] == expected
