"""Array helpers shared by the parser and the field extractors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    A column that is read inside a lambda may be inlined there by the optimizer and
    then be evaluated once per element; a lambda variable is evaluated exactly once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def last(items: Column) -> Column:
    return let(items, lambda xs: F.get(xs, F.size(xs) - 1))


def non_empty(items: Column) -> Column:
    return F.filter(items, lambda x: x != "")


def string_array(*values: str) -> Column:
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def run_starts(items: Column, key: str) -> Column:
    """Of sorted structs, the first of every run that agrees in ``key``."""
    return let(items, lambda s: F.filter(s, lambda e, i: (i == 0) | (F.get(s, i - 1)[key] != e[key])))


def run_ends(items: Column, key: str) -> Column:
    """Of sorted structs, the last of every run that agrees in ``key``."""
    return let(items, lambda s: F.filter(s, lambda e, i: (i == F.size(s) - 1) | (F.get(s, i + 1)[key] != e[key])))


def unique_ignoring_case(items: Column) -> Column:
    """Distinct by lower case; the first spelling and the input order stay.

    Set operations, which work by hash. Of two spellings that agree in lower case at least one isn't
    lower case itself, so only such elements and those equal to their lower case are sorted; with
    ``sort_array``, for ``array_sort`` calls an interpreted comparator for every two elements.
    """

    def firsts(xs: Column) -> Column:
        keyed = F.transform(xs, lambda x, i: F.struct(F.lower(x).alias("key"), i.alias("at"), x.alias("value")))
        return F.transform(run_starts(F.sort_array(keyed), "key"), lambda e: e["value"])

    def without_repeats(xs: Column, cased: Column) -> Column:
        alike = F.array_intersect(xs, F.concat(cased, F.transform(cased, F.lower)))
        return F.array_except(xs, let(alike, lambda a: F.array_except(a, firsts(a))))

    def checked(xs: Column) -> Column:
        cased = F.filter(xs, lambda x: x != F.lower(x))
        return let(cased, lambda c: F.when(F.size(c) == 0, xs).otherwise(without_repeats(xs, c)))

    return let(F.array_distinct(items), checked)


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The state after each item, starting from ``zero``.

    States are appended to chunks of about the square root of the length, and the chunks joined at
    the end: appending to one list would copy it for every item.
    """

    def over(xs: Column, width: Column) -> Column:
        def chunk(state: Column, begin: Column) -> Column:
            return F.aggregate(
                F.slice(xs, begin + 1, width),
                F.struct(state.alias("state"), F.slice(F.array(zero), 1, 0).alias("states")),
                lambda acc, x: let(
                    step(acc["state"], x),
                    lambda s: F.struct(s.alias("state"), F.concat(acc["states"], F.array(s)).alias("states")),
                ),
            )

        return F.aggregate(
            F.sequence(F.lit(0), F.size(xs) - 1, width),
            F.struct(zero.alias("state"), F.slice(F.array(F.array(zero)), 1, 0).alias("chunks")),
            lambda acc, begin: let(
                chunk(acc["state"], begin),
                lambda c: F.struct(c["state"].alias("state"), F.concat(acc["chunks"], F.array(c["states"])).alias("chunks")),
            ),
            lambda acc: F.flatten(acc["chunks"]),
        )

    def bound(xs: Column) -> Column:
        return let(F.ceil(F.sqrt(F.size(xs))).cast("int"), lambda width: over(xs, width))

    return let(items, lambda xs: F.when(F.size(xs) == 0, F.slice(F.array(zero), 1, 0)).otherwise(bound(xs)))


def sorted_set(items: Column) -> Column:
    return F.array_sort(F.array_distinct(items))


def joined(items: Column, separator: str = ", ") -> Column:
    """List cell: elements joined, NULL or empty list as the empty string."""
    return F.coalesce(F.array_join(items, separator), F.lit(""))


def ordered_concat(position: Column, items: Column) -> Column:
    """Aggregate: concatenate one array per row in the order of ``position``."""
    return F.flatten(
        F.transform(
            F.array_sort(F.collect_list(F.struct(position.alias("at"), items.alias("items")))),
            lambda row: row["items"],
        )
    )
