"""Names of projects from the addresses of their repositories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def project_key(remote: Column) -> Column:
    """host/path in lower case, without protocol, user, port of a URL, trailing slashes and `.git`."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(remote), "/+$", ""), r"(?i)\.git$", "")
    short = F.concat_ws("/", F.regexp_extract(plain, "^[^@/]+@([^:/]+):(.+)$", 1), F.regexp_extract(plain, "^[^@/]+@([^:/]+):(.+)$", 2))
    url = F.regexp_replace(F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/]*@)?", ""), r"^([^/:]+):\d+", "$1")
    path = F.when(plain.rlike("^[^@/]+@[^:/]+:.+$"), short).otherwise(url)
    return F.regexp_replace(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/+", "/")


def display_name(key: Column) -> Column:
    return F.coalesce(F.element_at(F.filter(F.split(key, "/"), lambda s: s != ""), -1), key)


def project_aliases(key: Column) -> Column:
    """The last two segments and the last one; a key of one segment is its own alias."""
    parts = F.filter(F.split(key, "/"), lambda s: s != "")
    return F.when(F.size(parts) >= 2, F.array(F.concat_ws("/", F.slice(parts, -2, 2)), F.element_at(parts, -1))).otherwise(F.array(key))


def redact_remote(remote: Column) -> Column:
    """A URL without user and password; other forms stay as they are."""
    return F.regexp_replace(remote, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^@/]*@", "$1")
