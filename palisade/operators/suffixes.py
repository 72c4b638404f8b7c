"""Public suffixes by a table of rules.

A rule is a suffix (``com.mx``), a wildcard (``*.ck``: one more label, whatever it is) or an exception (``!www.ck``: not a
suffix, although a wildcard says so). Each distinct host asks for all of its tails by one equi-join, so the list may have any
size; an exception wins over everything, otherwise the longest rule, and a host that meets none ends in its last label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.binding import bound
from palisade.functions.urls import is_dotted_quad
from palisade.operators.enrichment import lookup


def suffix_rules(rules: DataFrame, column: str = "rule") -> DataFrame:
    """``(tail, plain, wildcard, exception)``, a row per tail, from rules as the public list writes them.

    Comments (``//``), empty lines and what follows a space are left out; case is folded.
    """
    text = F.lower(F.regexp_extract(F.ltrim(F.col(column)), r"^\S*", 0))
    written = rules.select(text.alias("rule")).filter((F.col("rule") != "") & ~F.col("rule").startswith("//"))
    tail = F.regexp_replace("rule", r"^(!|\*\.)", "")
    kinds = {"wildcard": F.col("rule").startswith("*."), "exception": F.col("rule").startswith("!")}
    plain = ~kinds["wildcard"] & ~kinds["exception"]
    return written.groupBy(tail.alias("tail")).agg(F.bool_or(plain).alias("plain"), *[F.bool_or(k).alias(n) for n, k in kinds.items()])


def suffix_lengths(hosts: DataFrame, host: str, rules: DataFrame) -> DataFrame:
    """``(host, n_labels)``: labels of the public suffix of each distinct host that meets a rule."""
    distinct = hosts.select(F.col(host).alias("host")).filter("host IS NOT NULL").distinct()
    labels = F.split("host", "[.]")
    asked = distinct.select("host", F.size(labels).alias("_all"), F.posexplode(F.transform(labels, lambda x, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))).alias("_at", "tail"))
    met = asked.join(suffix_rules(rules), "tail")
    own = F.col("_all") - F.col("_at")  # labels of the tail
    beyond = F.when(F.col("wildcard") & (F.col("_at") > 0), own + 1)
    longest = F.greatest(F.when(F.col("plain"), own), beyond)
    per_host = met.groupBy("host").agg(F.max(longest).alias("longest"), F.max(F.when(F.col("exception"), own - 1)).alias("excepted"))
    return per_host.select("host", F.coalesce("excepted", "longest").alias("n_labels")).filter("n_labels IS NOT NULL")


def names_of(host: Column, n_labels: Column) -> Column:
    """Struct of suffix, domain, subdomain, registered_domain where the suffix has ``n_labels`` labels, one if NULL.

    An IP address has no suffix, and its domain is itself; a host that is a suffix has neither domain nor registered domain.
    """
    numeric = is_dotted_quad(host) | host.contains(":")

    def cut(labels: Column) -> Column:
        count = F.size(labels)
        start = count - F.least(F.coalesce(n_labels, F.lit(1)), count)  # labels in front of the suffix
        joined = lambda first, length: F.array_join(F.slice(labels, first, length), ".")
        return F.struct(
            F.when(numeric, "").otherwise(joined(start + 1, count)).alias("suffix"),
            F.when(numeric, host).when(start > 0, F.get(labels, start - 1)).otherwise("").alias("domain"),
            F.when(~numeric & (start > 1), joined(F.lit(1), F.greatest(start - 1, F.lit(0)))).otherwise("").alias("subdomain"),
            F.when(~numeric & (start > 0), joined(F.greatest(start, F.lit(1)), count)).otherwise("").alias("registered_domain"),
        )

    return F.when(host.isNotNull(), bound(F.split(host, "[.]"), cut))


def with_names(df: DataFrame, host: str, rules: DataFrame, name: str = "names") -> DataFrame:
    """``df`` with the struct ``name`` of ``names_of``, by a table of rules; rows without a host get NULL."""
    lengths = suffix_lengths(df, host, rules)
    found = lookup(df, host, lengths, "host", {"_n_labels": F.col("n_labels")})
    return found.withColumn(name, names_of(F.col(host), F.col("_n_labels"))).drop("_n_labels")
