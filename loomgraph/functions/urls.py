"""Checks of URLs and paths."""

from __future__ import annotations

import ipaddress
import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F

URL_CAP = 2048


def url_violation(url: Column) -> Column:
    """The first rule that a URL breaks, null if none; only its text is looked at."""
    host = F.regexp_extract(url, r"^https?://([^/]*)", 1)
    return (
        F.when(F.octet_length(url) > URL_CAP, "too long")
        .when(url.rlike("[ \\p{Cc}\\u202A-\\u202E\\u2066-\\u2069\\u200B-\\u200F\\uFEFF]"), "unsafe character")
        .when(~url.rlike("^https?://"), "scheme")
        .when(host == "", "no host")
        .when(F.contains(host, F.lit("@")), "credentials")
    )


def url_extension(url: Column) -> Column:
    """Extension of the path's last segment in lower case, ``rs`` where there is none."""
    plain = F.regexp_replace(url, r"[?#].*$", "")
    path = F.when(F.contains(plain, F.lit("://")), F.regexp_extract(plain, r"^.*?://[^/]*(/.*)?$", 1)).otherwise(plain)
    last = F.element_at(F.split(path, "/"), -1)
    ext = F.lower(F.regexp_extract(last, r"\.([^.]+)$", 1))
    return F.when(ext == "", "rs").otherwise(ext)


# Address ranges that must not be fetched.
BLOCKED = {
    "loopback": ("127.0.0.0/8", "::1/128"),
    "unspecified": ("0.0.0.0/32", "::/128"),
    "private": ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"),
    "link-local": ("169.254.0.0/16", "fe80::/10"),
    "shared": ("100.64.0.0/10",),
    "unique-local": ("fc00::/7",),
}
_NETS = [(why, ipaddress.ip_network(n)) for why, nets in BLOCKED.items() for n in nets]


def ip_blocked(address: str) -> str | None:
    """Why an address must not be fetched; IPv4 inside IPv6 counts as IPv4."""
    ip = ipaddress.ip_address(address)
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return next((why for why, net in _NETS if ip.version == net.version and ip in net), None)


def url_blocked(url: str) -> str | None:
    """Why a URL must not be fetched; host names aren't resolved here."""
    scheme, sep, rest = url.partition("://")
    if not sep or scheme.lower() not in ("http", "https"):
        return "scheme"
    for mark in "/\\?#":
        rest = rest.split(mark, 1)[0]
    host = rest.rpartition("@")[2]
    host = host[1:].split("]", 1)[0] if host.startswith("[") else host.rpartition(":")[0] if host.rpartition(":")[2].isdigit() and ":" in host else host
    if not host:
        return "no host"
    if host.lower().rstrip(".") == "localhost":
        return "loopback"
    try:
        return ip_blocked(host)
    except ValueError:
        return None


def confine(root: str, candidate: str) -> str:
    """The normal form of ``candidate`` below ``root``; a ValueError if it leaves it."""
    base = posixpath.normpath(root)
    full = posixpath.normpath(posixpath.join(base, candidate))
    if full != base and not full.startswith(base.rstrip("/") + "/"):
        raise ValueError(f"path leaves {root}")
    return full
