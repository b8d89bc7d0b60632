"""Property tests (hypothesis); each example set is evaluated in one Spark job."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_EVEN, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitrine.functions import brl, signed_percent, text_chunks

SETTINGS = settings(max_examples=15, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(texts=st.lists(st.text(max_size=300), min_size=1, max_size=20),
       size=st.integers(min_value=1, max_value=64))
def test_chunks_concatenate_in_order(spark, texts, size):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got: dict[int, list[tuple[int, str]]] = {}
    for r in text_chunks(df, "t", size=size).collect():
        got.setdefault(r.k, []).append((r.parte, r.texto))
    for k, t in enumerate(texts):
        parts = sorted(got.get(k, []))
        assert [p for p, _ in parts] == list(range(len(parts)))
        assert [c for _, c in parts] == [t[i:i + size] for i in range(0, len(t), size)]


@SETTINGS
@given(values=st.lists(st.floats(min_value=-1e12, max_value=1e12, allow_nan=False), min_size=1,
                       max_size=30))
def test_formats_equal_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    rows = df.select("i", brl(F.col("x")).alias("b"), signed_percent(F.col("x")).alias("p")).collect()
    for r in rows:
        v = values[r.i]
        assert re.fullmatch(r"R\$ -?\d{1,3}(\.\d{3})*,\d{2}", r.b), r.b
        amount = Decimal(r.b[3:].replace(".", "").replace(",", "."))
        assert amount == Decimal(v).quantize(Decimal("0.01"), ROUND_HALF_EVEN), v
        assert r.p == f"{v:+.1f}%", v
