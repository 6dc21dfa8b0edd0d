"""Column helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space is these six characters and nothing else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

# At most this many keys of a frame can each hold more than 1/HOT_SHARE of its rows.
HOT_SHARE = 1000


def whole(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` has it in a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def own(docs: DataFrame, *names: str) -> list[str]:
    """Working names that do not clash with any column of ``docs``, in any case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def named(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of rows with one line for each of their keys, whatever share a key holds.

    ``size`` is the number of rows of a key.  Keys with more than 1/HOT_SHARE
    of all rows, of which there can be fewer than HOT_SHARE, are broadcast, so
    their rows stay where they are; all other keys are shuffled and joined.
    Both frames are read twice and should come from files.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.filter(F.col(size) * HOT_SHARE > total)
    rest = groups.filter(F.col(size) * HOT_SHARE <= total)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(cold.join(rest, key))
