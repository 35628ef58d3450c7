"""Named queries: a Spark callable and, where SQL can say it, the same query as plain SQL."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import spread
from .oracle import ORACLE_PARTS
from .views import BASE_TABLES, VIEWS

TEXT_TABLES = ("documents", "pages", "conversations")  # heavy work per row

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Reads base tables and the derived views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._named: dict[str, str] = {}

    def _base(self, name: str, wide: bool = False) -> str:
        """Name of a temporary view of a base table, so its schema is read once per query; ``wide`` spreads its rows."""
        key = f"{name}_wide" if wide else name
        if key not in self._named:
            view = f"t_{zlib.crc32(self.folder.encode())}_{key}"
            df = self(name)
            (spread(df) if wide else df).createOrReplaceTempView(view)
            self._named[key] = view
        return self._named[key]

    def __call__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            return spread(df) if name in TEXT_TABLES else df
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, text: str, spread_out: tuple[str, ...] = ()) -> DataFrame:
        """A query over base tables and views; the tables of ``spread_out`` feed heavy work per row."""
        used = [b for b in BASE_TABLES if re.search(rf"\b{b}\b", with_parts(text, VIEWS))]
        base = {b: f"SELECT * FROM {self._base(b, b in spread_out)}" for b in used}
        return self.spark.sql(with_parts(text, {**base, **VIEWS}))


def with_parts(text: str, parts: dict[str, str]) -> str:
    """Put the named parts a query uses in front of it, each after the parts it needs."""
    order: list[str] = []
    seen: set[str] = set()

    def visit(body: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z]\w*\b", body)):
            if word in parts and word not in seen:
                seen.add(word)
                visit(parts[word])
                order.append(word)

    visit(text)
    if not order:
        return text
    head = ",\n".join(f"{n} AS (\n{parts[n]}\n)" for n in order)
    text = text.strip()
    if re.match(r"WITH RECURSIVE\s", text):
        return f"WITH RECURSIVE {head},\n{text[14:].strip()}"
    if re.match(r"WITH\s", text):
        return f"WITH {head},\n{text[4:].strip()}"
    return f"WITH {head}\n{text}"


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` may use base tables and views by name."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = with_parts(sql, {**VIEWS, **ORACLE_PARTS})
        return fn

    return wrap
