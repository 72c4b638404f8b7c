"""Row-wise numeric features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.binding import bound
from palisade.functions.urls import character_entropy


def per_second(amount: Column, seconds: Column) -> Column:
    """Rate; NULL when the duration is zero."""
    return F.try_divide(amount.cast("double"), seconds.cast("double"))


def pair_variance(a: Column, b: Column) -> Column:
    """Sample variance of two values."""
    gap = a.cast("double") - b.cast("double")
    return gap * gap / 2


def protocol_entropy(protocol: Column) -> Column:
    return character_entropy(protocol)


def ipv4_number(ip: Column) -> Column:
    """Dotted quad as a long, NULL when it is not one."""
    def combine(octets: Column) -> Column:
        value = F.aggregate(octets, F.lit(0).cast("long"), lambda acc, o: acc * 256 + o)
        return F.when(F.forall(octets, lambda o: o.between(0, 255)), value)

    shaped = ip.rlike(r"^[0-9]{1,3}([.][0-9]{1,3}){3}$")
    return F.when(shaped, bound(F.transform(F.split(ip, "[.]"), lambda o: o.try_cast("long")), combine))


def clipped(score: Column) -> Column:
    """NaN and NULL become 0, everything else is held within [0, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(score.cast("double"), F.lit(0.0)), F.lit(0.0))))
