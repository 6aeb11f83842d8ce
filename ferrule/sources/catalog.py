"""The tables that entity queries read, by name, and the display texts of their coded columns."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_LITERAL = re.compile(r"'(?:[^'\\]|\\.|'')*'")


@dataclass(frozen=True)
class Display:
    """A column's codes are keys of a lookup table; its label column has their texts."""

    lookup: str
    key: str
    label: str


class Catalog:
    """Names are local to a catalog: its views have a prefix of their own, and a query's text names tables through common table
    expressions, so raw fragments and sub-queries see them too. Session settings are never changed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.prefix = f"ferrule_{uuid.uuid4().hex[:12]}"
        self.frames: dict[str, DataFrame] = {}
        self.paths: dict[str, str] = {}
        self.displays: dict[tuple[str, str], Display] = {}
        self.unique: dict[Display, bool] = {}

    def add(self, name: str, df: DataFrame) -> Catalog:
        df.createOrReplaceTempView(f"{self.prefix}_{name}")
        self.frames[name] = df
        return self

    def add_parquet(self, folder: str, *names: str) -> Catalog:
        """Files are looked at when a table is first used."""
        self.paths |= {name: f"{folder}/{name}.parquet" for name in names}
        return self

    def table(self, name: str) -> DataFrame:
        if name not in self.frames and name in self.paths:
            self.add(name, self.spark.read.parquet(self.paths[name]))
        if name not in self.frames:
            raise KeyError(f"Table '{name}' is not registered.")
        return self.frames[name]

    def add_display(self, table: str, column: str, lookup: str, key: str, label: str) -> Catalog:
        self.displays[table, column] = Display(lookup, key, label)
        return self

    def has_unique_keys(self, d: Display) -> bool:
        """Whether a lookup has each key once; found out when it's first used."""
        if d not in self.unique:
            key = F.col(f"`{d.key}`")
            rows, keys = self.table(d.lookup).filter(key.isNotNull()).agg(F.count(key), F.count_distinct(key)).first()
            self.unique[d] = rows == keys
        return self.unique[d]

    def sql(self, text: str, args: list) -> DataFrame:
        """Runs a query over the catalog's tables with positional parameters. Tables are named after FROM, JOIN or a comma."""
        bare = _LITERAL.sub("''", text)
        used = [n for n in self.frames | self.paths if re.search(rf"(?i)(?:\bfrom|\bjoin|,)[\s(]+`?{re.escape(n)}(?![\w.])", bare)]
        for n in used:
            self.table(n)
        head = ", ".join(f"`{n}` AS (SELECT * FROM `{self.prefix}_{n}`)" for n in used)
        return self.spark.sql(f"WITH {head} {text}" if head else text, args=args)

    def drop(self) -> None:
        for name in self.frames:
            self.spark.catalog.dropTempView(f"{self.prefix}_{name}")
