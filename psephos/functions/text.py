"""Names, keys and types of files, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    """The last segment; back slashes count as slashes."""
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), "[^/]*$", 0)


def stem(path: Column) -> Column:
    """The basename without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]*$", "")


def folder_ballot(folder: Column) -> Column:
    """Ballot id of a folder name: one leading ``ballot_`` is taken off."""
    return F.regexp_replace(folder, "^ballot_", "")


# Content types by extension.
CONTENT_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff"}


def content_type(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(basename(path), r"\.([^.]*)$", 1))
    out = F.when(F.lit(False), F.lit(""))
    for kind in dict.fromkeys(CONTENT_TYPES.values()):
        out = out.when(extension.isin([e for e, k in CONTENT_TYPES.items() if k == kind]), kind)
    return out.otherwise("application/octet-stream")


def safe_filename(name: Column) -> Column:
    """A basename fit for a file: trimmed, without NUL, ``upload`` if nothing is left."""
    return F.coalesce(F.nullif(F.trim(F.replace(basename(name), F.lit("\0"), F.lit(""))), F.lit("")), F.lit("upload"))


def object_key(key: Column) -> Column:
    """The key of an object event, with plus signs and percent escapes undone."""
    return F.url_decode(key)


def claim_key(bucket: Column, key: Column, version: Column, etag: Column) -> Column:
    """The identity of one version of one object."""
    return F.concat_ws("::", bucket, key, F.coalesce(F.nullif(version, F.lit("")), F.lit("no-version")), F.replace(F.coalesce(etag, F.lit("")), F.lit('"'), F.lit("")))


def joined_key(prefix: Column, path: Column) -> Column:
    """Object key under a prefix for a relative path."""
    inside = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", "")
    trimmed = F.regexp_replace(prefix, "/+$", "")
    return F.when(trimmed == "", inside).otherwise(F.concat(trimmed, F.lit("/"), inside))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in columns])


def html_escaped(text: Column) -> Column:
    """Text safe inside HTML, quotes included."""
    out = text
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def numbered_filename(name: Column, number: Column) -> Column:
    """The name itself as the first of its kind (0), then with ``_1``, ``_2``... before its extension."""
    extension = F.substring(name, F.length(stem(name)) + 1, F.length(name))
    return F.when(number == 0, name).otherwise(F.concat(stem(name), F.lit("_"), number.cast("string"), extension))


def byte_matches(content: Column, pattern: str) -> Column:
    """How often a pattern occurs in bytes, each byte as the character of its number."""
    return F.regexp_count(F.decode(content, "ISO-8859-1"), F.lit(pattern)).cast("long")
