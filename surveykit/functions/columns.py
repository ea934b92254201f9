"""Column-returning helpers (projections, recodes, bands, text formats).

All are built from ``pyspark.sql.functions`` so they stay inside whole-stage codegen.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def recode(c: Column | str, mapping: Mapping) -> Column:
    """Dictionary recode; unknown or null keys give null (a literal map lookup)."""
    c = F.col(c) if isinstance(c, str) else c
    if not mapping:
        return F.lit(None)
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.when(c.isNotNull(), m[c])


def reverse_lookup(mapping: Mapping, value):
    """Label → key (first key whose label equals ``value``), or None."""
    return next((k for k, v in mapping.items() if v == value), None)


def membership_class(c: Column | str, members: Sequence, inside: str, outside: str) -> Column:
    """Two-way class by set membership (null stays in the 'outside' class like ``in``)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isin(list(members)), F.lit(inside)).otherwise(F.lit(outside))


def band(c: Column | str, cuts: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Threshold banding: first ``value >= cut`` wins, in the order given."""
    c = F.col(c) if isinstance(c, str) else c
    expr = None
    for cut, label in cuts:
        expr = F.when(c >= cut, F.lit(label)) if expr is None else expr.when(c >= cut, F.lit(label))
    return expr.otherwise(F.lit(otherwise)) if expr is not None else F.lit(otherwise)


def flag(c: Column | str, null_as: bool = False) -> Column:
    """0/1 flag → boolean. ``null_as`` is the value given to a null flag
    (pandas' ``astype(bool)`` turns NaN into True: pass ``null_as=True`` for parity)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c != 0, F.lit(null_as))


def share_true(cond: Column) -> Column:
    """Mean of a boolean where a null comparison counts as false over *all* rows."""
    return F.count_if(F.coalesce(cond, F.lit(False))).cast("double") / F.count(F.lit(1))


def percent(c: Column, digits: int | None = 1) -> Column:
    """×100, optionally rounded half-to-even (pandas ``round``)."""
    v = c * 100
    return F.bround(v, digits) if digits is not None else v


def money_text(c: Column) -> Column:
    """'$' + truncated integer."""
    return F.concat(F.lit("$"), c.cast("int").cast("string"))


def percent_text(c: Column, decimals: int = 1) -> Column:
    return F.format_string(f"%.{decimals}f%%", c)


def count_text(c: Column) -> Column:
    """Thousands-separated integer text."""
    return F.format_number(c.cast("bigint"), 0)


def strip_prefix(c: Column | str, prefix: str = "The ") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(c, F.lit(prefix), F.lit(""))


def items_text(c: Column | str, sep: str = " + ") -> Column:
    """Sorted item array → display text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.array_sort(c), sep)


def truncate_text(c: Column | str, n: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.substring(c, 1, n)
