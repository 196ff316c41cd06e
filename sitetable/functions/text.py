"""Small string, hash and timestamp expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def content_hash(html: Column | str) -> Column:
    """SHA-256 hex digest of the UTF-8 page source."""
    return F.sha2(_col(html), 256)


def dom_hash(dom: Column | str) -> Column:
    """MD5 hex digest of the rendered DOM."""
    return F.md5(_col(dom))


def content_key(*columns: Column | str) -> Column:
    """Deterministic row id over the given columns; nulls and empty strings stay apart."""
    parts = [F.coalesce(F.concat(F.lit("="), _col(c).cast("string")), F.lit("~")) for c in columns]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def table_name(url: Column | str, default: str = "site_table", limit: int = 64) -> Column:
    """Table name for a source URL: scheme dropped, other characters folded to ``_``, cut at ``limit``.

    Long URLs may share a cut name; ``operators.sync.task_table`` keeps them apart.
    """
    name = F.regexp_replace(_col(url), "https?://", "")
    name = F.regexp_replace(name, "[^a-zA-Z0-9_]", "_")
    name = F.btrim(F.regexp_replace(name, "_+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(clip(name, limit), F.lit("")), F.lit(default))


def clip(text: Column | str, limit: int) -> Column:
    """The first ``limit`` characters."""
    return F.substring(_col(text), 1, limit)


def count_of(text: Column | str, part: str) -> Column:
    """Non-overlapping occurrences of ``part``."""
    text = _col(text)
    rest = F.length(F.replace(text, F.lit(part), F.lit("")))
    return F.floor((F.length(text) - rest) / F.lit(len(part)))


def flat_list(values: Column | str) -> Column:
    """List-valued attribute as one string, joined with spaces."""
    return F.concat_ws(" ", _col(values))


def in_share(key: Column | str, fraction: float) -> Column:
    """True for a share of the keys, by hash: stable when other keys are added. False for a null key."""
    place = F.conv(F.substring(F.md5(_col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return F.coalesce(place < int(fraction * 2**32), F.lit(False))


def iso_utc(ts: Column | str) -> Column:
    """ISO timestamp with microseconds and a trailing Z (session zone UTC)."""
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def is_nested(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.StructType | T.MapType | T.ArrayType | T.VariantType)


def as_text(column: Column | str, data_type: T.DataType) -> Column:
    """Text form of a value: nested values as JSON, everything else cast to string."""
    return F.to_json(_col(column)) if is_nested(data_type) else _col(column).cast("string")
