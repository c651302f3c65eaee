"""Small tables of the shapes that operators work on, for Spark and, as the same literals, for SQL."""

from __future__ import annotations

DUCK = {"string": "varchar", "int": "integer", "long": "bigint", "double": "double", "boolean": "boolean", "date": "date"}


def duck_type(kind: str) -> str:
    return duck_type(kind[6:-1]) + "[]" if kind.startswith("array<") else DUCK[kind]


def literal(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


class Fixture:
    """Rows with a schema (name kind, ...)."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows
        self.columns = [c.rsplit(" ", 1) for c in schema.split(", ")]

    def frame(self, spark):
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        names = ", ".join(f'v."{n}"::{duck_type(k)} as "{n}"' for n, k in self.columns)
        values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        return f"(select {names} from (values {values}) v({', '.join(f'"{n}"' for n, _ in self.columns)}))"
