"""Gold views: the marts under their schema-qualified names, for any SQL in the session.

A persistent view cannot read a temporary one, so every mart is written to a version folder
and its view reads that path. The view is the pointer to the version: replacing it is one catalog
change, and queries that already read the version before still find its files, which go with the
next publication. Unlike the loaded tables (``sources.tables``) the views carry the marts' own
types, without the contract's casts and lengths.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vitrine.plans.marts import Marts, sales_mart
from vitrine.plans.readonly import MART_VIEWS
from vitrine.schemas import GOLD_TABLES
from vitrine.sources.tables import ContractViolation, discard_versions, key_violations


def _frame(marts: Marts, attribute: str) -> DataFrame:
    if attribute == "sales" and not marts.with_daily_context:
        return sales_mart(marts.raw, True)
    return getattr(marts, attribute)


def publish_views(spark: SparkSession, marts: Marts, base: str, check_keys: bool = True) -> dict[str, str]:
    """Write the three marts below ``base`` and point their views at them; view -> folder.

    All three are written and their keys checked before the first view changes. The sales are
    partitioned by month, so a query over a month reads that month. A loaded table of the same name
    is in the way and refused.
    """
    written = {}
    for view, (attribute, schema) in MART_VIEWS.items():
        name = f"{schema}.{view}"
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema}")
        if spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType != "VIEW":
            raise ValueError(f"{name} is a table; read it with MartSource(spark, catalog=True), or drop it first")
        df, path = _frame(marts, attribute), f"{base.rstrip('/')}/{schema}/{view}/version-{uuid.uuid4().hex}"
        keys = GOLD_TABLES[name]["partitioned_by"]
        out = df.hint("rebalance", *keys) if keys else df
        out.write.partitionBy(*keys).parquet(path)
        written[name] = path, df.columns
    if check_keys:
        for name, (path, _) in written.items():
            bad = key_violations({name: (spark.read.parquet(path), GOLD_TABLES[name]["key"])}).limit(5).collect()
            if bad:
                for n, (p, _) in written.items():
                    discard_versions(spark, p.rpartition("/")[0], keep=_shown(spark, n))
                raise ContractViolation(f"{name}: key is NULL or repeated, e.g. "
                                        + ", ".join(f"{r.chave!r} x{r.ocorrencias}" for r in bad))
    for name, (path, columns) in written.items():
        before = _shown(spark, name)
        spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT {', '.join(f'`{c}`' for c in columns)} "
                  f"FROM parquet.`{path}`")
        discard_versions(spark, path.rpartition("/")[0], keep=(path, *before))
    return {name: path for name, (path, _) in written.items()}


def _shown(spark: SparkSession, name: str) -> tuple[str, ...]:
    """Folder that the view shows now, if it is there."""
    if not spark.catalog.tableExists(name):
        return ()
    files = spark.table(name).inputFiles()
    return tuple({"/".join(f.split("/")[:k + 1]) for f in files for k, part in enumerate(f.split("/"))
                  if part.startswith("version-")})
