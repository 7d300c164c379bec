"""Semantic schemas: files of `name<delimiter>Type` lines that give columns their role."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import types as T

# The roles a schema file may name.
ROLES = ("Num", "Cat", "MultiCat", "Text", "Key", "Label", "Other")


class EngineError(Exception):
    """An input or a parameter the engine can't work with."""


@dataclass(frozen=True)
class SemanticSchema:
    """Column names with their roles, in file order."""

    columns: tuple[tuple[str, str], ...]

    def names(self, *roles: str) -> list[str]:
        return [n for n, r in self.columns if r in roles]

    @property
    def key(self) -> list[str]:
        return self.names("Key")

    @property
    def label(self) -> list[str]:
        return self.names("Label")

    @property
    def num(self) -> list[str]:
        return self.names("Num")

    @property
    def cat(self) -> list[str]:
        return self.names("Cat")

    @property
    def multi_cat(self) -> list[str]:
        return self.names("MultiCat")

    @property
    def text(self) -> list[str]:
        return self.names("Text")

    @property
    def other(self) -> list[str]:
        return self.names("Other")

    @property
    def feat(self) -> list[str]:
        return self.names("Num", "Cat", "MultiCat", "Text")

    @property
    def struct(self) -> T.StructType:
        """Num is DOUBLE, every other role STRING, all nullable."""
        return T.StructType([T.StructField(n, T.DoubleType() if r == "Num" else T.StringType(), True) for n, r in self.columns])


def parse_schema(lines: list[str], delimiter: str = ";", one_label: bool = False) -> SemanticSchema:
    """A schema from its lines; `delimiter` is a regular expression, blank lines are skipped, an unknown role is an error."""
    cols = []
    for line in lines:
        if not line.strip():
            continue
        parts = [p.strip() for p in re.split(delimiter, line.strip())]
        if len(parts) < 2 or parts[1] not in ROLES:
            raise EngineError(f"not a schema line: {line!r}; roles are {', '.join(ROLES)}")
        cols.append((parts[0], parts[1]))
    out = SemanticSchema(tuple(cols))
    if one_label and len(out.label) != 1:
        raise EngineError(f"the schema names {len(out.label)} labels")
    return out


def read_schema(spark: SparkSession, path: str, delimiter: str = ";", one_label: bool = False) -> SemanticSchema:
    """A schema file, one line a column, from any file system of the session (a small file, read on the driver)."""
    rows = spark.read.option("wholetext", True).text(path).collect()
    return parse_schema([line for r in rows for line in r[0].splitlines()], delimiter, one_label)
