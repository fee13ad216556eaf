"""URL functions. Hosts of ASCII letters are handled natively; only others go through an Arrow function for IDNA."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evispark.functions.text import strip

#: scheme, credentials, host, port, path, query of an absolute HTTP(S) URL
_URL = r"^(?i:(https?))://(?:([^/?#@]*)@)?([^/?#:@\[\]]+)(?::(\d*))?([^?#]*)(\?[^#]*)?(?:#.*)?$"


@F.pandas_udf(StringType())
def _idna(hosts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(host: str) -> str | None:
        try:
            return host.encode("idna").decode("ascii")
        except UnicodeError:
            return None

    for s in hosts:
        yield s.map(one, na_action="ignore")


def _parts(url: Column) -> Column:
    """The six parts by one pass of the pattern; an array of another length where it doesn't match."""
    return F.split(F.regexp_replace(url, _URL, "$1\u0001$2\u0001$3\u0001$4\u0001$5\u0001$6"), "\u0001", -1)


def normalize_url(url: Column, international: bool = False) -> Column:
    """Scheme and host in small letters, default port and fragment dropped, empty path ``/``, query kept as it is.

    Null for anything but an absolute HTTP(S) URL, for credentials and for other ports. Hosts outside ASCII need
    ``international``, which adds an Arrow function to the plan; without it they give null.
    """
    parts = _parts(strip(url))
    part = lambda k: F.get(parts, F.lit(k))
    scheme, port, path, query = F.lower(part(0)), part(3), part(4), part(5)
    host = F.regexp_replace(F.lower(part(2)), "\\.$", "")
    host = _idna(host) if international else F.when(host.rlike("^[\\x21-\\x7e]+$"), host)
    default = F.when(scheme == "https", "443").otherwise("80")
    fine = (F.size(parts) == 6) & (part(1) == "") & ((port == "") | (port == default)) & (host != "")
    return F.when(fine, F.concat(scheme, F.lit("://"), host, F.when(path == "", F.lit("/")).otherwise(path), F.when(query == "?", F.lit("")).otherwise(query)))


def host(url: Column) -> Column:
    """Host in small letters; null if there is none."""
    return F.nullif(F.regexp_extract(F.lower(url), r"^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 5)


def domain_allowed(url: Column, domains: Column) -> Column:
    """Whether the host is one of the domains or below one, dot by dot. False where either is null."""
    h = host(url)
    return F.coalesce(F.exists(domains, lambda d: (h == d) | F.endswith(h, F.concat(F.lit("."), d))), F.lit(False))


@F.pandas_udf(StringType())
def resolve(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link against the address of its page; null where either is null or can't be resolved."""

    def one(b, x):
        try:
            return urljoin(b, x) if b is not None and x is not None else None
        except ValueError:
            return None

    return pd.Series([one(b, x) for b, x in zip(base, link)], dtype=object)


@F.pandas_udf(StringType())
def _decoded(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in values:
        yield s.map(lambda v: unquote(v).casefold(), na_action="ignore")


def keyword_score(values: list[Column], keywords: list[str], percent_encoded: bool = True) -> Column:
    """How many keywords stand in the joined, decoded, case-folded values; each counts once.

    Native where ``percent_encoded`` is false; decoding percent escapes leniently takes an Arrow function.
    """
    whole = F.concat_ws(" ", *values)
    whole = _decoded(whole) if percent_encoded else F.lower(whole)
    return sum((F.contains(whole, F.lit(k.casefold())).cast("int") for k in keywords), F.lit(0))
