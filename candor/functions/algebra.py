"""Annotation algebra as column expressions.

A monomial is a map from variable to exponent; a polynomial is an array of monomials. Rows that haven't been
aggregated have one monomial. Products never distribute: all monomials of both sides are multiplied into one. Sums
concatenate, keep like terms apart and drop constants. A variable is `<name>_<origin's ts>`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ONE = "map()"
VARS_TYPE = "map<string,bigint>"


def one() -> Column:
    """The constant monomial."""
    return F.expr(ONE).cast(VARS_TYPE)


def times(*monomials: Column) -> Column:
    """Product of monomials: exponents of a variable add up; null counts as the constant."""
    merge = lambda a, b: F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0).cast("bigint")) + F.coalesce(y, F.lit(0).cast("bigint")))
    return reduce(merge, [F.coalesce(m, one()) for m in monomials])


def product(poly: Column) -> Column:
    """All monomials of a polynomial multiplied into one, as a product of polynomials does."""
    merge = lambda a, b: F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0).cast("bigint")) + F.coalesce(y, F.lit(0).cast("bigint")))
    return F.aggregate(poly, one(), merge)


def plus(polys: Column) -> Column:
    """Sum of an array of polynomials: monomials side by side, without constants."""
    return F.filter(F.flatten(polys), lambda m: F.size(m) > 0)


def degree(monomial: Column) -> Column:
    return F.aggregate(F.map_values(monomial), F.lit(0).cast("bigint"), lambda a, x: a + x)


def cardinality(monomial: Column) -> Column:
    return F.size(monomial)


def degree_sum(poly: Column) -> Column:
    return F.aggregate(poly, F.lit(0).cast("bigint"), lambda a, m: a + degree(m))


def max_degree(poly: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(poly, degree)), F.lit(0).cast("bigint"))


def simplify(monomial: Column, first: str, second: str) -> Column:
    """Cancels variables of two constraints on one origin against each other: the larger keeps the difference."""

    def rest(name: Column, exponent: Column) -> Column:
        swap = lambda a, b: F.concat(F.lit(b), F.substring(name, len(a) + 1, 1 << 20))
        partner = F.when(F.startswith(name, F.lit(first + "_")), swap(first, second)).when(F.startswith(name, F.lit(second + "_")), swap(second, first))
        return exponent - F.coalesce(F.try_element_at(monomial, partner), F.lit(0).cast("bigint"))

    return F.map_filter(F.transform_values(monomial, rest), lambda _, x: x > 0)


def exponents(monomial: Column, prefix: str = "") -> Column:
    """Set of exponents of variables with a prefix; {0} if there is none."""
    found = F.array_distinct(F.map_values(F.map_filter(monomial, lambda k, _: F.startswith(k, F.lit(prefix)))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(0).cast("bigint")))


def origin_ts(variable: Column) -> Column:
    return F.regexp_extract(variable, r"_(-?\d+)$", 1).cast("bigint")


def slide(monomial: Column, start: Column, end: Column) -> Column:
    """Keeps variables whose origin lies in [start, end)."""
    return F.map_filter(monomial, lambda k, _: (F.regexp_extract(k, r"_(-?\d+)$", 1) != "") & (origin_ts(k) >= start) & (origin_ts(k) < end))


def quantify_without(poly: Column, prefixes: list[str]) -> Column:
    """How many monomials have no variable with any of the prefixes."""
    has = lambda m: F.exists(F.map_keys(m), lambda k: reduce(lambda a, b: a | b, [F.startswith(k, F.lit(p)) for p in prefixes]))
    return F.size(F.filter(poly, lambda m: ~has(m)))


def text(monomial: Column) -> Column:
    """Canonical text, variables in order: 1<SC_3>^2<SC_7>^1. Exponents of zero or less are left out."""
    # sort_array compares structs in compiled code; array_sort would call a lambda for each comparison
    entries = F.sort_array(F.filter(F.map_entries(monomial), lambda e: e["value"] > 0))
    return F.concat(F.lit("1"), F.array_join(F.transform(entries, lambda e: F.concat(F.lit("<"), e["key"], F.lit(">^"), e["value"].cast("string"))), ""))


def poly_text(poly: Column) -> Column:
    return F.array_join(F.transform(poly, text), "+")
