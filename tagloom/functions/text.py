"""Column functions whose meaning differs between SQL dialects, fixed here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat_skipping_nulls(*parts: Column | str) -> Column:
    return F.concat_ws("", *parts)


def substr_from_zero(column: str, length: int) -> Column:
    """substr(s, 0, n) as where positions start at 1: n - 1 characters."""
    return F.substring(column, 1, length - 1)


def capitalized(column: str) -> Column:
    return F.concat(F.upper(F.substring(column, 1, 1)), F.lower(F.expr(f"substring(`{column}`, 2)")))


def joined_sorted(column: Column | str, separator: str = ", ", distinct: bool = False) -> Column:
    """Values joined in their own order, so that the result doesn't depend on that of the rows; nulls are skipped."""
    values = F.collect_set(column) if distinct else F.collect_list(column)
    return F.array_join(F.sort_array(values), separator)


def epoch(column: Column | str) -> Column:
    return F.unix_timestamp(column)


def money(column: Column | str) -> Column:
    """A double as an exact amount, so that sums don't depend on their order."""
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(18,2)")


def total(column: Column | str) -> Column:
    return F.sum(money(column)).cast("double")


def ranged(lower: Column, upper: Column, bounds: str = "[)") -> Column:
    """A range value: struct of lower, upper and which ends belong to it."""
    return F.struct(lower.alias("lower"), upper.alias("upper"), F.lit(bounds[0] == "[").alias("lower_inc"), F.lit(bounds[1] == "]").alias("upper_inc"))


def in_ranged(value: Column, r: str) -> Column:
    low = F.col(f"{r}.lower").isNull() | (value > F.col(f"{r}.lower")) | (F.col(f"{r}.lower_inc") & (value == F.col(f"{r}.lower")))
    high = F.col(f"{r}.upper").isNull() | (value < F.col(f"{r}.upper")) | (F.col(f"{r}.upper_inc") & (value == F.col(f"{r}.upper")))
    return low & high


def enum_order(column: str, labels: list[str]) -> Column:
    """A label's place, by which enums sort."""
    return F.array_position(F.array(*map(F.lit, labels)), F.col(column))


def pascal(c: Column) -> Column:
    """user_accounts: UserAccounts."""
    word = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))
    return F.array_join(F.transform(F.split(c, "_"), word), "")


def camel(c: Column) -> Column:
    """user_accounts: userAccounts."""
    made = pascal(c)
    return F.concat(F.lower(F.substring(made, 1, 1)), F.substring(made, 2, 1 << 30))


def singular(c: Column) -> Column:
    """An English plural's singular, by its ending; short words and those in ss, us and is stay."""
    cut = lambda n: F.left(c, F.length(c) - n)
    return (
        F.when((F.length(c) <= 2) | c.rlike("(ss|us|is)$"), c).when(c.endswith("ies") & (F.length(c) > 4), F.concat(cut(3), F.lit("y")))
        .when(c.rlike("(s|x|z|ch|sh)es$"), cut(2)).when(c.endswith("s"), cut(1)).otherwise(c)
    )


def singular_last(c: Column) -> Column:
    """post_tags: post_tag."""
    last = F.substring_index(c, "_", -1)
    return F.concat(F.left(c, F.length(c) - F.length(last)), singular(last))
