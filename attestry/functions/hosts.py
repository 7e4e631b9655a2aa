"""Hosts of the URLs in a text, and what kind of address each is. Spark has no function for IP addresses."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Fixed value: the address at which cloud machines serve their metadata.
METADATA = "169.254.169.254"
URL = r"""(?i)(https?://[^\s"'<>]+)"""
HOST = ArrayType(StructType([StructField(c, StringType()) for c in ("raw", "kind", "category")]))


def address(host: str):
    """The IP address that a host stands for: dotted, a.b, decimal, 0x hexadecimal or IPv6; None for a name."""
    try:
        if host.isascii() and host.isdigit():
            return ipaddress.IPv4Address(int(host))
        if host[:2] == "0x":
            return ipaddress.IPv4Address(int(host[2:], 16))
        first, dot, last = host.partition(".")
        if dot and first.isdigit() and last.isdigit():
            return ipaddress.IPv4Address(f"{first}.0.0.{last}")
        return ipaddress.ip_address(host.strip("[]"))
    except ValueError:
        return None


def host(url: str) -> tuple[str, str, str]:
    try:
        name = urlsplit(url).hostname
    except ValueError:
        name = None
    if not name:
        return url, "name", "unparseable"
    ip = address(name)
    if ip is None:
        return name, "name", "public"
    kinds = {"metadata": str(ip) == METADATA, "loopback": ip.is_loopback, "link_local": ip.is_link_local, "private": ip.is_private}
    return name, "ip", next((k for k, is_so in kinds.items() if is_so), "public")


@F.pandas_udf(HOST)
def _hosts(urls: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in urls:
        yield part.map(lambda found: None if found is None else [dict(zip(("raw", "kind", "category"), host(u), strict=True)) for u in found])


def hosts(text: Column) -> Column:
    """array<struct<raw, kind, category>>, one a URL, in order; null for null."""
    return _hosts(F.regexp_extract_all(text, F.lit(URL), F.lit(1)))
