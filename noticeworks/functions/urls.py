"""Addresses: registered domains, join keys, safe schemes, file names."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of two labels under which names are registered.
COMPOUND_ENDINGS = ["ac.in", "edu.in", "gov.in", "co.in", "org.in", "res.in", "nic.in", "co.uk", "ac.uk", "gov.uk"]


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def registered_domain(url: Column) -> Column:
    """The last two labels of the host, three under a compound ending; '' without a host."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    last2 = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")
    return F.when(n <= 2, F.array_join(labels, ".")).when(last2.isin(*COMPOUND_ENDINGS), F.array_join(F.slice(labels, n - 2, 3), ".")).otherwise(last2)


def third_party_host(url: Column, own: Column) -> Column:
    """The host of ``url`` if its domain differs from that of ``own``, else ''."""
    a, b = registered_domain(url), registered_domain(own)
    return F.when((a != "") & (b != "") & (a != b), host(url)).otherwise("")


def url_key(url: Column) -> Column:
    """Key for joins: trimmed, without scheme and closing slash, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(url), "/+$", ""), "^(?i)https?://", ""))


def is_web_url(url: Column) -> Column:
    """True for http and https addresses with a host."""
    return F.coalesce(url.rlike(r"(?i)^https?://[^/\s]+"), F.lit(False))


def safe_link(url: Column) -> Column:
    """The address if its scheme may be linked, or if it has none and starts a path; else ''."""
    x = F.trim(F.coalesce(url, F.lit("")))
    return F.when(x.rlike(r"(?i)^(?:https?|mailto):"), x).when(x.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), "").when(x.rlike("^[/#?.]"), x).otherwise("")


def is_pdf_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)\.pdf(?:$|[?#])"), F.lit(False))


def pdf_file_name(url: Column) -> Column:
    """A file name for a document: the sanitised stem, at most 90 characters, and 12 digits of the address's hash."""
    last = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)/?$", 1)
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(last, r"(?i)\.pdf$", ""), r"[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.concat(F.substring(F.when(stem == "", "document").otherwise(stem), 1, 90), F.lit("__"), F.substring(F.sha2(url, 256), 1, 12), F.lit(".pdf"))


def quoted(url: Column) -> Column:
    """Blanks and brackets percent-quoted, what is quoted already left alone."""
    for sign, code in ((" ", "%20"), ("(", "%28"), (")", "%29"), ("[", "%5B"), ("]", "%5D"), ('"', "%22")):
        url = F.replace(url, F.lit(sign), F.lit(code))
    return url


def is_public_url(url: str | None, resolve: Callable[[str], list[str]]) -> bool:
    """True if the scheme is http(s), the host resolves, and every address is public. ``resolve`` is injected: no network here."""
    parts = urlsplit(url or "")
    if parts.scheme not in ("http", "https") or not parts.hostname:
        return False
    try:
        found = resolve(parts.hostname)
    except OSError:
        return False
    return bool(found) and all(ipaddress.ip_address(a).is_global and not ipaddress.ip_address(a).is_multicast for a in found)
