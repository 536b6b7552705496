"""Column builders on arrays: vectors, arg-max, framing, sets, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column, zero=0) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(zero), lambda s, x: s + x)


def total(a: Column, zero=0) -> Column:
    return F.aggregate(a, F.lit(zero), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a, 0.0))


def rotate(a: Column, k: Column | int) -> Column:
    """Element i moves to place i + k, around the end."""
    n = F.size(a)
    cut = F.pmod(F.lit(k) if isinstance(k, int) else k, n)
    return F.concat(F.slice(a, n - cut + 1, cut), F.slice(a, 1, n - cut))


def arg_max(a: Column) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("long")


def every_nth(a: Column, k: int) -> Column:
    return F.filter(a, lambda x, i: i % k == 0)


def pair_means(a: Column) -> Column:
    """Means of neighbours two by two; an odd last element is dropped."""
    half = F.floor(F.size(a) / 2).cast("int")
    places = F.when(half > 0, F.sequence(F.lit(1), half)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: (F.element_at(a, 2 * i - 1) + F.element_at(a, 2 * i)) / 2)


def with_midpoints(a: Column) -> Column:
    """The midpoint of each two neighbours between them."""
    return F.flatten(F.transform(a, lambda x, i: F.when(i < F.size(a) - 1, F.array(x, (x + F.get(a, i + 1)) / 2)).otherwise(F.array(x))))


def shifted(a: Column, by, low, high) -> Column:
    """Every element moved, and only those that stay within low to high."""
    return F.filter(F.transform(a, lambda x: x + by), lambda x: (x >= low) & (x <= high))


def nearest_rank(a: Column, share: float) -> Column:
    """sorted[floor(share * n)]: an element of the array, never a mean of two."""
    n = F.size(a)
    return F.element_at(F.array_sort(a), F.least(n, F.floor(n * share).cast("int") + 1))


def padded_frames(a: Column, lead: int, frame: int, hop: int) -> Column:
    """Overlapping frames of an array after `lead` zeros; zeros fill the last."""
    n = F.size(a) + lead
    count = F.greatest(F.lit(1), F.ceil((n - frame) / hop).cast("int") + 1)
    padded = F.concat(F.array_repeat(F.lit(0.0), lead), a, F.array_repeat(F.lit(0.0), frame + hop))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(padded, k * hop + 1, frame))


def known_ids(serialized: Column, legacy: Column | None = None) -> Column:
    """The non-empty strings of a JSON list; corrupt text: the legacy default, else an empty list."""
    got = F.filter(F.from_json(serialized, "array<string>", {"mode": "PERMISSIVE"}), lambda x: x.isNotNull() & (x != ""))
    return F.array_distinct(F.coalesce(got, legacy if legacy is not None else F.array().cast("array<string>")))


def id_list(ids: Column) -> Column:
    """A sorted JSON list of the distinct ids."""
    return F.to_json(F.array_sort(F.array_distinct(ids)))


def same_values(a: Column, b: Column) -> Column:
    """Element-wise equality in which NaN equals NaN and null equals null."""
    return a.eqNullSafe(b)
