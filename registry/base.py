"""Registration of ready queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gaugeline.session import prepare


@dataclass(frozen=True)
class Entry:
    name: str
    ids: tuple[str, ...]
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    digits: dict[str, int] = field(default_factory=dict)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(prepare(spark), sf_dir)
        return df.select(*[self._shown(f) for f in df.schema.fields])

    def _shown(self, f: T.StructField):
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return (F.round(F.col(f.name).cast("double"), self.digits.get(f.name, 6)) + F.lit(0.0)).alias(f.name)
        return F.col(f.name)

    def oracle(self) -> str | None:
        """The check SQL with the same rounding of the double columns, which ``digits`` must name."""
        if self.sql is None:
            return None
        if not self.digits:
            return self.sql
        replaced = ", ".join(f'round(CAST("{c}" AS DOUBLE), {d}) + 0.0::DOUBLE AS "{c}"' for c, d in self.digits.items())
        return f"SELECT * REPLACE ({replaced}) FROM (\n{self.sql}\n) AS shown"


ENTRIES: dict[str, Entry] = {}


def query(name: str, ids: str, sql: str | None = None, doubles: str = "", digits: dict[str, int] | None = None):
    """Decorator. ``doubles`` names the double columns (six digits); ``digits`` sets other precisions."""
    shown = {c: 6 for c in doubles.split()}
    shown.update(digits or {})

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        ENTRIES[name] = Entry(name, tuple(ids.split()), fn, sql, shown)
        return fn

    return add
