"""Look-ups of addresses in ranges, IPv4 and IPv6 alike.

An address is 128 bits; an IPv4 one lies in ``::ffff:0:0/96``. A range is written as the few prefixes it consists of, so an
address is in a range if one of its own prefixes is a prefix of the range: one equi-join on the prefix for all lengths that
occur, and no comparison of intervals. Of several ranges the narrowest counts.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.binding import bound
from palisade.functions.numeric import ipv4_number
from palisade.operators.enrichment import lookup

_PREFIXES = "length int, high long, low long, size decimal(38,0), value string"


def address_halves(ip: Column) -> Column:
    """Struct of the two 64-bit halves (as signed longs) of an address and ``v4``; NULL for anything else."""
    quad = ipv4_number(ip)
    text = F.lower(ip)
    last = ipv4_number(F.regexp_extract(text, r":([0-9.]+)$", 1))  # the last 32 bits may be written as a dotted quad
    groups = F.concat(F.regexp_extract(text, r"^(.*:)[0-9.]+$", 1), F.lower(F.hex(F.shiftright(last, 16))), F.lit(":"), F.lower(F.hex(last.bitwiseAND(F.lit(65535)))))
    plain = F.when(~text.contains("."), text).when(last.isNotNull(), groups)

    def of_sides(sides: Column) -> Column:
        side = lambda i: F.filter(F.split(F.coalesce(F.get(sides, F.lit(i)), F.lit("")), ":"), lambda x: x != "")
        left, right = side(0), side(1)
        missing = 8 - F.size(left) - F.size(right)
        whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
        shaped = F.when(F.size(sides) == 1, missing == 0).when(F.size(sides) == 2, missing > 0).otherwise(False)
        tidy = ~plain.rlike("(^|[^:]):$|^:[^:]|:::") & F.forall(whole, lambda x: x.rlike("^[0-9a-f]{1,4}$"))
        digits = F.array_join(F.transform(whole, lambda x: F.lpad(x, 4, "0")), "")
        half = lambda at: F.conv(F.substring(digits, at, 16), 16, -10).cast("long")
        return F.when(shaped & tidy, F.struct(half(1).alias("high"), half(17).alias("low"), F.lit(False).alias("v4")))

    mapped = F.struct(F.lit(0).cast("long").alias("high"), (quad + F.lit(0xFFFF << 32)).alias("low"), F.lit(True).alias("v4"))
    return F.when(quad.isNotNull(), mapped).otherwise(bound(F.split(plain, "::", -1), of_sides))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def range_prefixes(ranges: DataFrame, value: str) -> DataFrame:
    """``(length, high, low, size, value)`` for the prefixes of ``ranges(first, last, value)``; bounds are addresses as text.

    Bounds of two families, that are no addresses or stand the wrong way round make no range.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for first, last, found in zip(*(batch[c].to_pylist() for c in ("first", "last", "value"))):
                try:
                    low, high = ipaddress.ip_address(first or ""), ipaddress.ip_address(last or "")
                    parts = list(ipaddress.summarize_address_range(low, high))
                except (ValueError, TypeError):
                    continue
                for part in parts:
                    start = int(part.network_address) + (0xFFFF << 32 if low.version == 4 else 0)
                    length = part.prefixlen + (96 if low.version == 4 else 0)
                    rows.append((length, _signed(start >> 64), _signed(start & ((1 << 64) - 1)), int(high) - int(low), found))
            for start in range(0, len(rows), 10_000):
                length, high_bits, low_bits, size, found = zip(*rows[start : start + 10_000])
                sizes = pa.array([min(s, 10**38 - 1) for s in size], pa.decimal128(38, 0))
                columns = [pa.array(length, pa.int32()), pa.array(high_bits, pa.int64()), pa.array(low_bits, pa.int64()), sizes, pa.array(found, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _PREFIXES.split(", ")])

    written = ranges.select(*[F.col(c).cast("string").alias(n) for c, n in (("first", "first"), ("last", "last"), (value, "value"))])
    return written.mapInArrow(split, _PREFIXES)


def locate(df: DataFrame, ip: str, ranges: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with ``name``, the value of the narrowest range that holds the address, ties by value; NULL where none does.

    Each distinct address asks once for each prefix length that a range of its family uses, at most 129 numbers.
    """
    best = range_prefixes(ranges, value).groupBy("length", "high", "low").agg(F.min(F.struct("size", "value")).alias("found"))
    lengths = sorted(r["length"] for r in best.select("length").distinct().collect())
    addresses = df.select(F.col(ip).alias("_ip")).distinct().withColumn("_a", address_halves(F.col("_ip"))).filter("_a IS NOT NULL")

    def keys(chosen: list[int]) -> Column:
        masks = [(n, _signed(((1 << 64) - 1) & ~((1 << (64 - min(n, 64))) - 1)), _signed(((1 << 64) - 1) & ~((1 << (128 - max(n, 64))) - 1))) for n in chosen]
        made = [F.struct(F.lit(n).alias("length"), F.col("_a.high").bitwiseAND(F.lit(h).cast("long")).alias("high"), F.col("_a.low").bitwiseAND(F.lit(low).cast("long")).alias("low")) for n, h, low in masks]
        return F.array(*made) if made else F.array().cast("array<struct<length:int,high:bigint,low:bigint>>")

    asked = addresses.select("_ip", F.explode(F.when(F.col("_a.v4"), keys([n for n in lengths if n >= 96])).otherwise(keys(lengths))).alias("k")).select("_ip", "k.*")
    located = asked.join(best, ["length", "high", "low"]).groupBy("_ip").agg(F.min("found").alias("found")).select("_ip", F.col("found.value").alias("value"))
    return lookup(df, ip, located, "_ip", {name: F.col("value")})
