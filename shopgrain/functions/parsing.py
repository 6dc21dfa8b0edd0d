"""Text-to-value expressions for Brazilian exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted layouts, in order of preference.  Day comes before
# month; month before day is the last resort and has no time.
_ISO = r"^\d{4}-\d{2}-\d{2}( \d{1,2}:\d{2}:\d{2}|T\d{1,2}:\d{2}:\d{2}Z?)?$"
_DMY_SLASH = r"^(\d{2})/(\d{2})/(\d{4})( \d{1,2}:\d{2}:\d{2})?$"
_DMY_DASH = r"^(\d{2})-(\d{2})-(\d{4})$"
_MDY_SLASH = r"^(\d{2})/(\d{2})/(\d{4})$"
TRUE_WORDS = ("true", "1", "sim", "s", "ativo", "a")


def first_non_empty(columns: Sequence[str], aliases: Sequence[str]) -> Column:
    """First alias that is a column and holds text, else ''."""
    present = [a for a in aliases if a in columns]
    if not present:
        return F.lit("")
    return F.coalesce(*[F.nullif(F.trim(F.col(f"`{a}`")), F.lit("")) for a in present], F.lit(""))


def parse_decimal_exact(s: Column) -> Column:
    """Number in Brazilian or plain notation; anything else is 0.

    With a comma present dots group thousands and the comma is the decimal mark.
    """
    bare = F.trim(F.replace(s, F.lit("R$"), F.lit("")))
    # translate drops the dots: they have no counterpart in the second list.
    plain = F.when(F.contains(s, F.lit(",")), F.translate(bare, ",.", ".")).otherwise(bare)
    return F.coalesce(plain.try_cast("decimal(38,10)"), F.lit(0).cast("decimal(38,10)"))


def parse_decimal_br(s: Column) -> Column:
    return parse_decimal_exact(s).cast("double")


def parse_date_multi(s: Column) -> Column:
    """Moment in the first layout that fits, else null."""
    text = F.trim(s)

    def moment(iso: Column) -> Column:
        return F.when(iso.rlike(_ISO), iso.try_cast("timestamp_ntz"))

    slash = F.regexp_replace(text, _DMY_SLASH, "$3-$2-$1$4")
    day_first = F.regexp_replace(slash, _DMY_DASH, "$3-$2-$1")
    return F.coalesce(
        moment(day_first), moment(F.regexp_replace(text, _MDY_SLASH, "$3-$1-$2"))
    )


def parse_bool_br(s: Column) -> Column:
    return F.lower(F.trim(s)).isin(*TRUE_WORDS)
