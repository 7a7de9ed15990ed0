"""JDBC source and sink for the operational database."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tidemart.functions.scalars import nan_to_null
from tidemart.schemas import FOREIGN_KEYS, LOAD_ORDER, RAW_COLUMNS


@dataclass(frozen=True)
class JdbcDatabase:
    url: str
    schema: str = "raw"
    properties: Mapping[str, str] = field(default_factory=dict)
    fetch_size: int = 10_000
    batch_size: int = 10_000

    def table(self, name: str) -> str:
        return f"{self.schema}.{name}"


@dataclass(frozen=True)
class ReadSplit:
    """How a table is cut into parallel reads: a numeric or date column with its bounds."""

    column: str
    lower: str
    upper: str
    partitions: int


def read_options(db: JdbcDatabase, table: str, split: ReadSplit | None) -> dict[str, str]:
    options = {
        **db.properties,
        "url": db.url,
        "dbtable": db.table(table),
        "fetchsize": str(db.fetch_size),
    }
    if split is not None:
        options |= {
            "partitionColumn": split.column,
            "lowerBound": split.lower,
            "upperBound": split.upper,
            "numPartitions": str(split.partitions),
        }
    return options


def extract_table(spark: SparkSession, db: JdbcDatabase, table: str, split: ReadSplit | None = None) -> DataFrame:
    """A whole source table. Without ``split`` one task reads it, so large tables need one."""
    return spark.read.format("jdbc").options(**read_options(db, table, split)).load()


def loadable(df: DataFrame, table: str) -> DataFrame:
    """Declared columns only, with NaN turned into NULL."""
    out = df.select(*RAW_COLUMNS[table])
    floats = [f.name for f in out.schema.fields if f.dataType.typeName() in ("double", "float")]
    return out.withColumns({c: nan_to_null(c) for c in floats})


def write_options(db: JdbcDatabase, table: str) -> dict[str, str]:
    return {
        **db.properties,
        "url": db.url,
        "dbtable": db.table(table),
        "batchsize": str(db.batch_size),
        "truncate": "true",
        "cascadeTruncate": "true",
    }


def load_tables(tables: Mapping[str, DataFrame], db: JdbcDatabase) -> list[str]:
    """Replace the contents of the given tables, parents before children.

    Emptying a table also empties those that refer to it, so these have to be given with it.
    """
    for child, _, parent in FOREIGN_KEYS:
        if parent in tables and child not in tables:
            raise ValueError(f"loading {parent} empties {child}; give both")
    loaded = []
    for table in (t for t in LOAD_ORDER if t in tables):
        writer = loadable(tables[table], table).write.format("jdbc").mode("overwrite")
        writer.options(**write_options(db, table)).save()
        loaded.append(table)
    return loaded
