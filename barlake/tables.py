"""Dataset declarations and the store that holds them."""

from __future__ import annotations

from dataclasses import dataclass, field
from string import Formatter

from pyspark.sql import DataFrameWriter, SparkSession
from pyspark.sql import types as T

# The declared type names and the Spark type each is stored as.
# Dates and datetimes are text, timestamps are epoch milliseconds.
TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "int64": T.LongType(),
    "int32": T.IntegerType(),
    "int16": T.ShortType(),
    "int8": T.ByteType(),
    "uint64": T.DecimalType(20, 0),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "bool": T.BooleanType(),
    "date": T.StringType(),
    "datetime": T.StringType(),
    "timestamp": T.LongType(),
}

# Smallest and largest value of every whole-number type.
WHOLE_RANGES: dict[str, tuple[int, int]] = {
    "int64": (-(2**63), 2**63 - 1),
    "int32": (-(2**31), 2**31 - 1),
    "int16": (-(2**15), 2**15 - 1),
    "int8": (-(2**7), 2**7 - 1),
    "uint64": (0, 2**64 - 1),
    "timestamp": (-(2**63), 2**63 - 1),
}

TEXT_TYPES = frozenset({"string", "date", "datetime"})

# Partition columns a path may name without declaring them; cut from `date`.
DERIVED = ("year", "month")

# Undeclared column of tables with a key filter: a hash of partition and key, which reads never show.
KEY_HASH = "_key_hash"
# A Bloom filter of a row group takes at most so many bytes and wrongly says "may be here" this often.
KEY_FILTER_BYTES, KEY_FILTER_ERROR = 1 << 20, 0.001


def default_key(columns: dict[str, str]) -> tuple[str, ...]:
    """First date-like, code-like and time-like column; else the first two."""
    found: list[str] = []
    for word in ("date", "code", "time"):
        hit = next((c for c in columns if word in c.lower()), None)
        if hit is not None and hit not in found:
            found.append(hit)
    return tuple(found) or tuple(columns)[:2]


@dataclass(frozen=True)
class Table:
    """One dataset: flat typed columns, a path layout and a key.

    `path` names the partition columns in braces, for example
    ``{name}/{Year}/{Month}.parquet``; ``{schema.Year}`` is accepted too.
    `calendar` says that Year and Month are the parts of `date`, which writes
    check and reads use for pruning. `key_filter` stores a Bloom filter of the
    keys with every file, so that an append of few rows reads only those row
    groups that may hold one of its keys.
    """

    name: str
    version: str
    columns: dict[str, str]
    path: str
    key: tuple[str, ...] = ()
    calendar: bool = False
    required: tuple[str, ...] = ()
    allowed: dict[str, tuple] = field(default_factory=dict)
    reads: tuple[str, ...] = ()
    key_filter: bool = False

    def __post_init__(self):
        unknown = {c: t for c, t in self.columns.items() if t not in TYPES}
        if not self.columns or unknown:
            raise ValueError(f"Columns need a known type: {unknown or self.name}")
        strangers = [p for p in self.partitions if p not in self.columns and p not in DERIVED]
        if strangers:
            raise ValueError(f"Path names undeclared columns: {strangers}")
        if self.derived and "date" not in self.columns:
            raise ValueError("year and month in a path need a date column")
        if self.calendar and any(self.columns.get(c) not in TEXT_TYPES
                                 for c in ("Year", "Month", "date")):
            raise ValueError("A calendar table needs Year, Month and date as text")
        names = [c.lower() for c in (*self.columns, *self.derived, *([KEY_HASH] if self.key_filter else []))]
        if len(set(names)) < len(names):
            raise ValueError("Column names must differ in more than case")
        if not self.key:
            object.__setattr__(self, "key", default_key(self.columns))

    @property
    def path_parts(self) -> list[tuple[str, str | None]]:
        """(literal text, column or None) pairs of the path, name and version filled in."""
        template = self.path.replace("{schema.", "{")
        template = template.replace("{name}", self.name).replace("{version}", self.version)
        return [(text, column) for text, column, _, _ in Formatter().parse(template)]

    @property
    def partitions(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(c for _, c in self.path_parts if c))

    @property
    def derived(self) -> tuple[str, ...]:
        return tuple(p for p in self.partitions if p not in self.columns)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, TYPES[t]) for c, t in self.columns.items()])

    @property
    def stored_schema(self) -> T.StructType:
        extra = [T.StructField(c, T.StringType()) for c in self.derived]
        return T.StructType(self.schema.fields + extra)

    @property
    def partition_types(self) -> dict[str, str]:
        return {p: self.columns.get(p, "string") for p in self.partitions}

    @property
    def identity(self) -> tuple[str, ...]:
        """Columns that decide whether two rows are the same: partition and key."""
        return tuple(dict.fromkeys((*self.partitions, *self.key)))

    def writer(self, writer: DataFrameWriter, store: Store) -> DataFrameWriter:
        """The writer with the options all files of this table are stored with."""
        writer = writer.option("compression", store.compression)
        if self.key_filter:
            for name, value in (("enabled", "true"), ("adaptive.enabled", "true"), ("max.bytes", KEY_FILTER_BYTES),
                                ("fpp", KEY_FILTER_ERROR)):
                column = "" if "." in name else f"#{KEY_HASH}"  # some are for all columns that have a filter
                writer = writer.option(f"parquet.bloom.filter.{name}{column}", value)
        return writer


# ---------------------------------------------------------------- shipped datasets

# Columns, their order and types, and paths of the shipped datasets.

_INTRADAY = {"Year": "string", "Month": "string", "date": "string", "time": "string", "market": "string",
             "stock_code": "string", "stock_name": "string", "open": "double", "close": "double",
             "high": "double", "low": "double", "volume": "int64"}
_DAILY = {"Year": "string", "Month": "string", "date": "string", "market": "string", "stock_code": "string",
          "stock_name": "string", "open": "double", "close": "double", "high": "double", "low": "double",
          "volume": "int64"}
_MEMBERS = {"index_code": "string", "index_name_en": "string", "index_name_cn": "string", "date": "string",
            "Year": "string", "Month": "string", "stock_code": "string", "stock_name": "string"}
BY_DAY = "{name}/{Year}/{Month}/{date}.parquet"
BY_MONTH = "{name}/{Year}/{Month}.parquet"
BY_INDEX = "{index_code}.parquet"

STOCK_5MIN = Table("stock_5min", "v1", _INTRADAY, BY_DAY, calendar=True)
STOCK_30MIN = Table("stock_30min", "v1", _INTRADAY, BY_MONTH, calendar=True)
STOCK_60MIN = Table("stock_60min", "v1", _INTRADAY, BY_MONTH, calendar=True)
STOCK_1DAY = Table("stock_1day", "v1", _DAILY, BY_MONTH, calendar=True)
INDEX_CONSTITUENTS = Table("index_constituents", "v1", _MEMBERS, BY_INDEX)

SHIPPED = (STOCK_5MIN, STOCK_30MIN, STOCK_60MIN, STOCK_1DAY, INDEX_CONSTITUENTS)


@dataclass(frozen=True)
class Store:
    """A base folder, the datasets declared for it and what may be done to them."""

    spark: SparkSession
    base: str
    tables: tuple[Table, ...] = SHIPPED
    compression: str = "snappy"
    allow_overwrite: bool = False
    allow_delete: bool = False

    def table(self, name: str, version: str = "v1") -> Table:
        # a later declaration of the same name and version replaces an earlier one
        for table in reversed(self.tables):
            if (table.name, table.version) == (name, version):
                return table
        raise KeyError(f"Dataset not declared: {name} {version}")

    def location(self, table: Table) -> str:
        return f"{self.base.rstrip('/')}/{table.name}/{table.version}"
