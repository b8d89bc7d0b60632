"""Raw tables: sales, customers, products and competitor price observations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.schemas import RAW_SCHEMAS


@dataclass(frozen=True)
class RawTables:
    """The four raw relations the marts are built from.

    ``price_tiebreak`` lists extra columns of ``preco_competidores`` that
    order observations with the same collection time (all descending), so
    that "latest price" is deterministic. Without them, the price itself
    breaks the tie.
    """

    vendas: DataFrame
    clientes: DataFrame
    produtos: DataFrame
    preco_competidores: DataFrame
    price_tiebreak: tuple[str, ...] = field(default=())

    def as_dict(self) -> dict[str, DataFrame]:
        return {
            "vendas": self.vendas,
            "clientes": self.clientes,
            "produtos": self.produtos,
            "preco_competidores": self.preco_competidores,
        }


def read_raw(spark: SparkSession, base_dir: str) -> RawTables:
    """Scan the four raw Parquet datasets under ``base_dir`` with fixed schemas.

    Explicit schemas skip inference; columns not used by a query are pruned by
    the Parquet reader and filters are pushed into the scan.
    """
    frames = {}
    for name, schema in RAW_SCHEMAS.items():
        df = spark.read.schema(schema).parquet(f"{base_dir}/{name}.parquet")
        frames[name] = df.select(*[F.col(f.name) for f in schema.fields])
    return RawTables(**frames)


def register_raw(raw: RawTables, suffix: str = "_raw") -> list[str]:
    """Expose the raw relations to SQL as ``vendas_raw`` etc."""
    names = []
    for name, df in raw.as_dict().items():
        df.createOrReplaceTempView(name + suffix)
        names.append(name + suffix)
    return names
