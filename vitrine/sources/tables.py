"""Gold tables: definition, type and key contracts, full-refresh loading.

Local warehouse tables are Parquet tables in the session catalog, created from
the fixed contract in ``vitrine.schemas.GOLD_TABLES`` (CHAR/VARCHAR lengths,
DECIMAL precision, SMALLINT/INT ranges). Spark enforces those on insert under
ANSI store assignment.

Publication is atomic. A table's files live in a version folder
(``.../vendas_temporais/version-<id>``) and its catalog entry is the pointer to it. A load
writes a new version through a staging table with the same contract, checks the key
there, and then points the table at the new folder: one catalog change, with no write
after it that could fail. Until that moment, whatever fails, the old rows are the table.
Partitions are found by listing the version folder, not kept in the catalog (there are as
many as months), so the same change covers them. The version before stays for queries that
already read it, until the next load.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vitrine.schemas import GOLD_TABLES

_LENGTH_TYPE = re.compile(r"^(CHAR|VARCHAR)\((\d+)\)$")


_VERSION = "version-"
_TRACK_PARTITIONS = "spark.sql.hive.manageFilesourcePartitions"


class ContractViolation(ValueError):
    """The data breaks the table contract; nothing was written."""


class PublicationError(RuntimeError):
    """The new rows are whole and checked, but the table still shows the old ones."""


def key_violations(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Keys that break a primary-key contract (NULL or not unique).

    ``tables`` maps a table name to ``(frame, key column)``. One row per bad
    key value: ``tabela, chave, ocorrencias``. Counting is a partially
    aggregated ``groupBy`` on the key, so a key repeated in a third of the rows
    still costs one row per map task in the shuffle.
    """
    parts = []
    for name, (df, key) in tables.items():
        k = F.col(key)
        parts.append(
            df.groupBy(k.alias("chave")).agg(F.count(F.lit(1)).alias("ocorrencias"))
            .where((F.col("ocorrencias") > 1) | F.col("chave").isNull())
            .select(F.lit(name).alias("tabela"), F.col("chave").cast("string").alias("chave"),
                    "ocorrencias"))
    return reduce(DataFrame.unionByName, parts)


def table_ddl(table: str, location: str | None = None, name: str | None = None) -> str:
    """``CREATE TABLE`` text of a gold table (``name`` overrides the table name)."""
    spec = GOLD_TABLES[table]
    cols = ",\n  ".join(f"{col} {typ}" for col, typ in spec["columns"])
    ddl = f"CREATE TABLE {name or table} (\n  {cols}\n) USING parquet"
    if spec["partitioned_by"]:
        ddl += f"\nPARTITIONED BY ({', '.join(spec['partitioned_by'])})"
    if location:
        ddl += f"\nLOCATION '{location}'"
    return ddl


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _create(spark: SparkSession, table: str, location: str, name: str | None = None) -> None:
    """A table over ``location`` whose partitions are those of the folder."""
    with _setting(spark, _TRACK_PARTITIONS, "false"):
        spark.sql(table_ddl(table, location, name))


def _new_version(root: str) -> str:
    return f"{root}/{_VERSION}{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str):
    """Hadoop file system and path of a folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def create_gold_tables(spark: SparkSession, location: str | None = None,
                       replace: bool = False) -> list[str]:
    """Create the gold tables (and their schemas) that are absent; returns their names.

    ``replace`` drops existing ones first, with their rows. ``location``, when given,
    is a base folder; the versions of each table live in ``{location}/{schema}/{table}``.
    Otherwise the schema's warehouse folder is used.
    """
    created = []
    for table in GOLD_TABLES:
        schema, plain = table.split(".")
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema}")
        if replace:
            if spark.catalog.tableExists(table):
                discard_versions(spark, _version_root(_table_location(spark, table)), keep=())
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        if not spark.catalog.tableExists(table):
            base = f"{location}/{schema}" if location else spark.catalog.getDatabase(schema).locationUri
            root = f"{base.rstrip('/')}/{plain}"
            _create(spark, table, _new_version(root))
            created.append(table)
    return created


def _version_root(location: str) -> str:
    """Folder of a table's versions; a table that was not made here gets one beside it."""
    parent, _, last = location.rstrip("/").rpartition("/")
    return parent if last.startswith(_VERSION) else f"{location.rstrip('/')}__versions"


def discard_versions(spark: SparkSession, root: str, keep: tuple[str, ...]) -> None:
    """Delete the version folders below ``root`` but those named."""
    kept = {path.rstrip("/").rpartition("/")[2] for path in keep}
    files, folder = _folder(spark, root)
    if not files.exists(folder):
        return
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith(_VERSION) and name not in kept:
            files.delete(status.getPath(), True)


def _string_type(typ: str) -> bool:
    return typ == "STRING" or bool(_LENGTH_TYPE.match(typ))


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select the contract's columns in table order, cast to the declared types.

    Strings are passed as STRING; the table's CHAR/VARCHAR length check runs on
    insert. Numeric casts follow ANSI rules (overflow raises).
    """
    spec = GOLD_TABLES[table]
    part = spec["partitioned_by"]
    ordered = [c for c in spec["columns"] if c[0] not in part] + \
        [c for c in spec["columns"] if c[0] in part]
    return df.select(*[
        (F.col(name) if _string_type(typ) else F.col(name).cast(typ)).alias(name)
        for name, typ in ordered
    ])


def _table_location(spark: SparkSession, table: str) -> str | None:
    for row in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect():
        if row.col_name == "Location":
            return row.data_type
    return None


def _entry(spark: SparkSession, table: str):
    """The session catalog, and a table's entry in it with its declared CHAR and VARCHAR types."""
    schema, plain = table.split(".")
    catalog = spark._jsparkSession.sessionState().catalog()
    name = spark._jvm.org.apache.spark.sql.catalyst.TableIdentifier(
        plain, spark._jvm.scala.Option.apply(schema))
    return catalog, catalog.getTableRawMetadata(name)


def _keeps_partitions_in_catalog(spark: SparkSession, table: str) -> bool:
    _, entry = _entry(spark, table)
    return entry.tracksPartitionsInCatalog() and entry.partitionColumnNames().nonEmpty()


def _publish(spark: SparkSession, table: str, location: str) -> None:
    """Point the table at a version folder: one change of its catalog entry.

    ``ALTER TABLE ... SET LOCATION`` would do, but writes CHAR and VARCHAR columns back as
    STRING, so the entry is changed as it is.
    """
    catalog, entry = _entry(spark, table)
    kept = entry.storage()
    _, folder = _folder(spark, location)
    catalog.alterTable(entry.withNewStorage(
        spark._jvm.scala.Option.apply(folder.toUri()), kept.inputFormat(), kept.outputFormat(),
        kept.compressed(), kept.serde(), kept.properties()))
    spark.catalog.refreshTable(table)


def full_refresh(df: DataFrame, table: str, check_key: bool = True) -> int:
    """Replace all rows of ``table`` with ``df``; returns the rows written.

    1. ``df`` is computed once and written to ``{table}__staging`` (same
       contract, a new version folder): a row that breaks a type contract fails
       this write and the target is untouched;
    2. the key is checked on the staged files (a partially aggregated
       ``groupBy``; only the first few offending keys reach the driver);
    3. the target is pointed at the staged folder, and the staging entry is dropped;
       no row is written after the check.

    A refused load deletes its folder and raises ``ContractViolation``. If step 3 fails,
    the target keeps its old rows and the staging table is kept, with all new ones, and
    named by the ``PublicationError``.

    The staging write replaces the whole folder, whatever the session says about partition
    overwriting. Rows of a partitioned table are gathered by partition first, so a
    month is a few files instead of one per task; adaptive execution splits large
    months. The row count is observed during the staging write, not by another pass.
    """
    spark = df.sparkSession
    if _keeps_partitions_in_catalog(spark, table):
        raise ValueError(f"{table} keeps its partitions in the catalog, so it cannot change its version at "
                         "once; create it with create_gold_tables")
    staging, before = f"{table}__staging", _table_location(spark, table)
    root = _version_root(before)
    version = _new_version(root)
    spark.sql(f"DROP TABLE IF EXISTS {staging}")
    _create(spark, table, version, name=staging)
    try:
        obs = Observation(f"rows_{table.replace('.', '_')}")
        _replace_rows(conform(df, table).observe(obs, F.count(F.lit(1)).alias("n")), table, staging)
        n = int(obs.get["n"])
        if check_key:
            key = GOLD_TABLES[table]["key"]
            bad = key_violations({table: (spark.table(staging), key)}).limit(5).collect()
            if bad:
                raise ContractViolation(
                    f"{table}: key {key} is NULL or repeated, e.g. "
                    + ", ".join(f"{r.chave!r} x{r.ocorrencias}" for r in bad))
    except Exception as exc:
        spark.sql(f"DROP TABLE IF EXISTS {staging}")
        discard_versions(spark, root, keep=(before,))
        if isinstance(exc, ContractViolation):
            raise
        raise ContractViolation(f"{table}: load refused: {exc}") from exc
    try:
        _publish(spark, table, version)
    except Exception as exc:
        raise PublicationError(f"{table} shows its old rows; all {n} new ones are in {staging}: {exc}") from exc
    spark.sql(f"DROP TABLE IF EXISTS {staging}")         # the entry only: its files are the table's now
    discard_versions(spark, root, keep=(before, version))
    return n


def _replace_rows(df: DataFrame, contract: str, target: str) -> None:
    keys = GOLD_TABLES[contract]["partitioned_by"]
    if keys:
        df = df.hint("rebalance", *keys)
    # insertInto heeds the session's setting only
    with _setting(df.sparkSession, "spark.sql.sources.partitionOverwriteMode", "static"):
        df.write.insertInto(target, overwrite=True)


def load_marts(marts, check_key: bool = True) -> dict[str, int]:
    """Full refresh of the three gold tables from ``marts``; rows per table.

    The sales table holds the per-day context, whether or not ``marts`` have it. A repeated or
    NULL key of the customers or products refuses the load before any table is written.
    """
    return {table: full_refresh(df, table, check_key) for table, df in mart_frames(marts).items()}


def mart_frames(marts) -> dict[str, DataFrame]:
    """Gold table -> rows, over inputs that are read once (see ``shared_inputs``)."""
    from vitrine.plans.marts import build_marts
    from vitrine.schemas import CUSTOMERS_MART, CUSTOMERS_SCHEMA, PRICING_MART, PRICING_SCHEMA
    from vitrine.schemas import SALES_MART, SALES_SCHEMA

    marts = build_marts(shared_inputs(marts.raw), with_daily_context=True)
    return {f"{SALES_SCHEMA}.{SALES_MART}": marts.sales,
            f"{CUSTOMERS_SCHEMA}.{CUSTOMERS_MART}": marts.customers,
            f"{PRICING_SCHEMA}.{PRICING_MART}": marts.pricing}


def gated_dimension(df: DataFrame, key: str, label: str) -> DataFrame:
    """The dimension's rows, written once; raises ``ContractViolation`` unless its key is unique and not NULL.

    Rows are merged by key for the write, so the same job that writes them observes how many keys are
    repeated or NULL; only if there are any, a few are looked up for the message.
    """
    from vitrine.operators.materialize import discard, materialize

    others, seen = [c for c in df.columns if c != key], Observation(f"keys_{label}")
    merged = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*others)).alias("row"))
    bad = (F.col("n") > 1) | F.col(key).isNull()
    written = materialize(merged.observe(seen, F.count_if(bad).alias("bad")), label)
    if seen.get["bad"]:
        some = written.where(bad).orderBy(F.desc("n"), key).limit(5).collect()
        discard(written)
        raise ContractViolation(f"{label}: key {key} is NULL or repeated, e.g. "
                                + ", ".join(f"{r[key]!r} x{r.n}" for r in some))
    return written.select(*[F.col(c) if c == key else F.col("row")[c].alias(c) for c in df.columns])


def shared_inputs(raw):
    """Raw tables for a job that builds all marts: each is scanned once.

    The dimensions pass the key gate. The sales are written in the columns the marts read; the three
    marts, the per-day totals among them, then read pruned columns of that copy.
    """
    from dataclasses import replace

    from vitrine.operators.materialize import materialize
    from vitrine.schemas import RAW_VENDAS

    clientes = gated_dimension(raw.clientes, "id_cliente", "clientes")
    produtos = gated_dimension(raw.produtos, "id_produto", "produtos")
    vendas = materialize(raw.vendas.select(*[f.name for f in RAW_VENDAS.fields]), "vendas")
    return replace(raw, vendas=vendas, clientes=clientes, produtos=produtos)


def require_unique_inputs(raw) -> None:
    """Raise ``ContractViolation`` if a customer or product key is NULL or repeated."""
    bad = input_key_violations(raw).limit(5).collect()
    if bad:
        raise ContractViolation("inputs: key is NULL or repeated, e.g. "
                                + ", ".join(f"{r.tabela} {r.chave!r} x{r.ocorrencias}" for r in bad))


def input_key_violations(raw) -> DataFrame:
    """Repeated or NULL keys of the customer and product tables (see ``key_violations``).

    The lean forms of the marts rely on them being unique.
    """
    return key_violations({"clientes": (raw.clientes, "id_cliente"),
                           "produtos": (raw.produtos, "id_produto")})


def warehouse_ddl(table: str, name: str | None = None, text_type: str = "VARCHAR(255)") -> str:
    """``CREATE TABLE`` text for a warehouse, with every column of the contract and its key."""
    spec = GOLD_TABLES[table]
    cols = [f"{col} {text_type if typ == 'STRING' else 'INTEGER' if typ == 'INT' else typ}"
            + (" NOT NULL" if col == spec["key"] else "") for col, typ in spec["columns"]]
    return f"CREATE TABLE {name or table} (\n  " + ",\n  ".join(
        [*cols, f"PRIMARY KEY ({spec['key']})"]) + "\n)"


def full_refresh_jdbc(df: DataFrame, table: str, url: str, properties: dict | None = None,
                      batch_size: int = 500, contract: str | None = None) -> int:
    """Replace the rows of a warehouse table over JDBC; returns the rows written.

    The rows are computed once (written to the checkpoint folder), their key is
    checked, and they go to ``{table}__staging`` in batches of ``batch_size`` per
    executor connection. Only then one transaction on the driver's connection
    deletes the old rows and inserts the staged ones: readers see the old table or
    the new one, and a refused row leaves the old one. A table that does not exist
    is created from the contract. ``contract`` names the gold table whose columns and
    types apply (default: ``table``).
    """
    from vitrine.operators.materialize import discard, materialize

    name = contract or table
    rows = materialize(conform(df, name), "warehouse")
    staging, key = f"{table}__staging", GOLD_TABLES[name]["key"]
    try:
        bad = key_violations({table: (rows, key)}).limit(5).collect()
        if bad:
            raise ContractViolation(f"{table}: key {key} is NULL or repeated, e.g. "
                                    + ", ".join(f"{r.chave!r} x{r.ocorrencias}" for r in bad))
        count = rows.count()
        (rows.write.format("jdbc").mode("overwrite").option("url", url).option("dbtable", staging)
         .option("batchsize", str(batch_size)).options(**(properties or {})).save())
        # Spark quotes the staging table's names, so the warehouse keeps their case
        columns = ", ".join(rows.columns)
        staged = ", ".join(f'"{c}"' for c in rows.columns)
        _in_transaction(df.sparkSession, url, properties or {}, table, warehouse_ddl(name, table), [
            f"DELETE FROM {table}",
            f"INSERT INTO {table} ({columns}) SELECT {staged} FROM {staging}",
            f"DROP TABLE {staging}"])
        return count
    except ContractViolation:
        raise
    except Exception as exc:
        raise ContractViolation(f"{table}: load refused: {exc}") from exc
    finally:
        discard(rows)


def _in_transaction(spark: SparkSession, url: str, properties: dict, table: str, ddl: str,
                    statements: list[str]) -> None:
    """Run the statements on one connection, all or none; create ``table`` first if absent."""
    jvm = spark._jvm
    if "driver" in properties:
        jvm.java.lang.Class.forName(properties["driver"], True,
                                    jvm.java.lang.Thread.currentThread().getContextClassLoader())
    settings = jvm.java.util.Properties()
    for k, v in properties.items():
        settings.setProperty(k, str(v))
    connection = jvm.java.sql.DriverManager.getConnection(url, settings)
    try:
        schema, _, plain = table.rpartition(".")
        found = False
        for case in (str, str.upper, str.lower):
            names = connection.getMetaData().getTables(None, case(schema) or None, case(plain), None)
            found = found or names.next()
            names.close()
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        try:
            for text in [*([] if found else [ddl]), *statements]:
                statement.executeUpdate(text)
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            statement.close()
    finally:
        connection.close()
