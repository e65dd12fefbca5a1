"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs without these six characters.
BLANKS = r"[\x20\x09-\x0D]+"
LARGEST_DATE_FREE_ID = -(2**63)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body).getItem(0)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS, -1), "")


def id_key(doc_id: Column) -> Column:
    """A key for joins in which a null id equals itself."""
    return F.coalesce(doc_id.cast("long"), F.lit(LARGEST_DATE_FREE_ID))


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names that clash with none of the given columns, whatever their case."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
