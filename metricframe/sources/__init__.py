"""``Connection``: a Spark session and named tables from files, frames, records, the catalog or other formats."""

from __future__ import annotations

from dataclasses import dataclass, field
from importlib.util import find_spec
from pathlib import Path
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, SparkSession

if TYPE_CHECKING:
    from metricframe.model import Model

_READERS = {
    ".parquet": lambda spark, path: spark.read.parquet(path),
    ".csv": lambda spark, path: spark.read.csv(path, header=True, inferSchema=True),
    ".json": lambda spark, path: spark.read.json(path, multiLine=True),
    ".orc": lambda spark, path: spark.read.orc(path),
}


def read(spark: SparkSession, content: Any) -> DataFrame:
    """A table's content as a DataFrame: a DataFrame, pandas frame, list of records or a file by its ending."""
    if isinstance(content, DataFrame):
        return content
    if isinstance(content, list):
        if not content:
            raise ValueError("no records to take columns and types from")
        return spark.createDataFrame(content)
    if isinstance(content, str | Path):
        ending = Path(str(content).rstrip("/")).suffix.lower()
        if ending in _READERS:
            return _READERS[ending](spark, str(content))
        if ending in (".xls", ".xlsx"):
            if find_spec("openpyxl" if ending == ".xlsx" else "xlrd") is None:
                raise RuntimeError(f"reading {content} needs an Excel engine for pandas, which is not installed")
            import pandas

            return spark.createDataFrame(pandas.read_excel(content))
        raise ValueError(f"no reader for files like {content}")
    if hasattr(content, "to_dict") and hasattr(content, "columns"):
        return spark.createDataFrame(content)
    raise TypeError(f"a {type(content).__name__} cannot be a table")


@dataclass(frozen=True)
class Connection:
    """Where tables are.  ``Connection(spark, sales="sales.parquet")``; names not given are the catalog's."""

    spark: SparkSession = field(repr=False)
    tables: dict[str, Any] = field(default_factory=dict, repr=False)
    #: Weeks begin on this day, Monday being 0.
    first_weekday: int = 6
    _read: dict[str, DataFrame] = field(default_factory=dict, repr=False, compare=False)

    def __init__(self, spark: SparkSession, first_weekday: int = 6, /, **tables: Any) -> None:
        object.__setattr__(self, "spark", spark)
        object.__setattr__(self, "tables", tables)
        object.__setattr__(self, "first_weekday", first_weekday)
        object.__setattr__(self, "_read", {})

    @classmethod
    def catalog(cls, spark: SparkSession) -> Connection:
        """The tables of the session's catalog."""
        return cls(spark)

    @classmethod
    def format(cls, spark: SparkSession, name: str, tables: dict[str, dict[str, str]], **shared: str) -> Connection:
        """Tables of any Spark data source, such as ``jdbc`` or ``bigquery``: options by table, and shared ones.

        Options may hold secrets: they stay in this process and are on no wire.
        """
        return cls(spark, **{t: spark.read.format(name).options(**shared, **options).load() for t, options in tables.items()})

    def with_table(self, name: str, content: Any) -> Connection:
        return Connection(self.spark, self.first_weekday, **(self.tables | {name: content}))

    def with_config(self, **config: Any) -> Connection:
        """The same tables, with Spark settings made on the session (dots in names as double underscores)."""
        for key, value in config.items():
            self.spark.conf.set(key.replace("__", "."), value)
        return self

    def with_first_weekday(self, day: int) -> Connection:
        return Connection(self.spark, day, **self.tables)

    def table(self, name: str, schema: str | None = None) -> DataFrame:
        if schema is None and name in self.tables:
            if name not in self._read:
                self._read[name] = read(self.spark, self.tables[name])
            return self._read[name]
        if schema is None and Path(name).suffix.lower() in _READERS:
            return read(self.spark, name)
        return self.spark.table(f"{schema}.{name}" if schema else name)

    def publish(self) -> None:
        """Make the tables known to raw SQL by their names."""
        for name in self.tables:
            self.table(name).createOrReplaceTempView(name)

    def models(self) -> dict[str, Model]:
        """A model for each table, its columns as attributes: of the given ones, or else of the catalog's."""
        from metricframe.model import Model

        names = list(self.tables) or [t.name for t in self.spark.catalog.listTables()]
        return {x: Model(self, x).with_attributes(*self.table(x).columns) for x in names}
