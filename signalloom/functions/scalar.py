"""Scalar functions: rate bands, harmonic ratios, labels, slugs, digests and canonical strings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BANDS = ((0.5, "below"), (4.0, "delta"), (8.0, "theta"), (13.0, "alpha"), (30.0, "beta"))


def band(x: Column) -> Column:
    """The band of a rate; bands are half-open, the last one ends at 100 inclusive."""
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for limit, name in BANDS:
        out = out.when(x < limit, name)
    return out.when(x <= 100, "gamma").otherwise("above")


def harmonic(a: Column, b: Column, tolerance: float = 0.015) -> Column:
    """2, 3 or 4 if the larger value is that many times the smaller within the tolerance, else null."""
    low, high = F.least(a, b), F.greatest(a, b)
    ratio = F.when(low > 0, high / F.nullif(low, F.lit(0.0)))
    near = F.bround(ratio)
    return F.when(near.between(2, 4) & (F.abs(ratio - near) <= tolerance * near), near).cast("bigint")


def carrier_pair(difference: Column, left: Column, right: Column) -> Column:
    """What two carriers are to each other."""
    return (
        F.when(harmonic(left, right).isNotNull(), "harmonic_relationship").when(difference < 0.1, "shared_carrier").when(difference < 0.5, "slight_detuning")
        .when(difference <= 40, "beat_candidate").otherwise("wide_interval")
    )


def candidate_score(left: Column, right: Column, difference: Column, is_harmonic: Column) -> Column:
    """Mean magnitude of a candidate, less for unequal sides, for differences outside 0.5 to 40 Hz and for harmonics."""
    return F.round((left + right) / 2 * (1 - F.abs(left - right)) * F.when(difference.between(0.5, 40), 1.0).otherwise(0.25) * F.when(is_harmonic, 0.1).otherwise(1.0), 4)


def label(x: Column) -> Column:
    """Lower-case words joined by underscores; camel case is split; null if nothing is left."""
    split = F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1_$2")
    return F.nullif(F.btrim(F.regexp_replace(F.lower(split), "[^a-z0-9]+", "_"), F.lit("_")), F.lit(""))


def slug(path: Column, length: int = 80) -> Column:
    """A readable name of a path: without suffix, in lower case, hyphens for all else, ``length`` characters; and 8 digits of the path's digest."""
    bare = F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")
    safe = F.btrim(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.concat(F.substring(safe, 1, length), F.lit("-"), F.substring(F.sha2(path, 256), 1, 8))


def canonical(*columns: Column) -> Column:
    """A string that two rows share only if all values are equal: lengths before values, nulls marked."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.concat_ws("|", *parts)


def content_id(prefix: str, *columns: Column) -> Column:
    """prefix_ and 16 hex digits of the digest of the canonical string."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(canonical(*columns), 256), 1, 16))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Size of the intersection over that of the union of two sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, both_empty).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


def wrap_phase(x: Column) -> Column:
    """An angle in [-pi, pi)."""
    import math

    return F.pmod(x + math.pi, F.lit(2 * math.pi)) - math.pi


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
