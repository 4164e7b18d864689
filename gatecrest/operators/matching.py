"""First-match classification by ordered rules, first or last row of a key, and first candidate that exists."""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Branches of one CASE; longer rule lists are split, so that generated code stays below the method limit.
BRANCHES = 40


def literal(text: str) -> str:
    """A string in SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def first_match(text: str, patterns: Sequence[str], needs: Sequence[Sequence[str]] | None = None) -> Column:
    """Ordinal of the first pattern that matches the column of that name; null if none does.

    needs: for each pattern literals of which a text must hold one for the pattern to match; they are looked for first,
    which is cheaper than the pattern. An empty list asks for none.
    """
    tests = [f"`{text}` RLIKE {literal(p)}" for p in patterns]
    for k, words in enumerate(needs or ()):
        if words:
            tests[k] = "(" + " OR ".join(f"contains(`{text}`, {literal(w)})" for w in words) + ") AND " + tests[k]
    cases = ["CASE " + " ".join(f"WHEN {t} THEN {k + i}" for i, t in enumerate(tests[k : k + BRANCHES])) + " END" for k in range(0, len(tests), BRANCHES)]
    return F.expr(cases[0] if len(cases) == 1 else f"coalesce({', '.join(cases)})")


def matched(df: DataFrame, text: str, patterns: Sequence[str], name: str, needs: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """The rows that a pattern matches, with its ordinal under name. The patterns are tried once a row, whatever is made of the ordinal: a generator, unlike a projection, is neither repeated nor pushed into filters."""
    return df.select("*", F.explode(F.filter(F.array(first_match(text, patterns, needs)), lambda k: k.isNotNull())).alias(name))


def lookup(ordinal: Column, values: Sequence) -> Column:
    """The value of that ordinal; null for null. Values are of one type: strings, whole numbers or truth values, or null."""
    kind = next((type(v) for v in values if v is not None), str)
    plain = {str: lambda v: literal(v), bool: lambda v: str(v).lower(), int: str}[kind]
    items = ", ".join("NULL" if v is None else plain(v) for v in values)
    return F.get(F.expr(f"array({items})"), ordinal)


def first_by(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """One row for each key, the first in order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def first_existing(df: DataFrame, key: str, candidates: str, existing: DataFrame, column: str) -> DataFrame:
    """df with the first of its candidate array that occurs in existing[column], as ``found``; null if none does."""
    tried = df.select(key, F.posexplode(candidates).alias("_k", column)).join(existing.select(column).distinct(), column)
    hit = tried.groupBy(key).agg(F.min(F.struct("_k", column)).alias("_m")).select(key, F.col(f"_m.{column}").alias("found"))
    return df.join(hit, key, "left")


def any_of(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))
