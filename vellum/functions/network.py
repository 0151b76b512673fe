"""Addresses: IPv4 validity, and hosts that an import must not reach."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_ipv4(value: Column) -> Column:
    """Four octets from 0 to 255 without leading zeros."""
    octets = F.split(value, r"\.")
    return F.coalesce((F.size(octets) == 4) & F.forall(octets, lambda o: o.rlike(r"^(0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])$")), F.lit(False))


def host(url: Column) -> Column:
    """The lower-case host of an http(s) URL; null if it is no such URL."""
    return F.nullif(F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/?#:]+)", 1)), F.lit(""))


def is_blocked_host(name: Column) -> Column:
    """True for private, loopback, link-local, shared, multicast and reserved addresses, IPv6 literals and local names.

    A name must also be checked after it is resolved, and after each redirect; this is about literals.
    """
    a, b = (F.try_element_at(F.split(name, r"\."), F.lit(i)).try_cast("int") for i in (1, 2))
    private = (
        a.isin(0, 10, 127)
        | (a >= 224)
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & b.isin(0, 168))
        | ((a == 169) & (b == 254))
        | ((a == 100) & b.between(64, 127))
        | ((a == 198) & b.isin(18, 19))
    )
    local = name.isin("localhost", "localhost.localdomain") | F.endswith(name, F.lit(".local")) | F.endswith(name, F.lit(".localhost")) | F.startswith(name, F.lit("["))
    return F.when(name.isNull() | local, True).when(is_ipv4(name), private).otherwise(name.rlike(r"^[\d.]+$"))
