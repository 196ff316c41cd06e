"""Personal data: detect, extract and redact, as native column expressions.

The five patterns run in a fixed order, each on the output of the one before it.
``mode='compat'`` keeps that order; ``mode='strict'`` tries cards before phones and
leaves ISO dates alone, so that a card is never half eaten by the phone pattern.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitetable.functions.json_names import redact_json_text

# The PII patterns, in the order in which they apply.
PATTERNS: dict[str, str] = {
    "email": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Z|a-z]{2,}\b",
    "id_card": r"\b\d{17}[\dXx]\b",
    "phone": r"(?<!\d)(\+?\d[\d\s\-\(\)]{7,14}\d)(?!\d)",
    "credit_card": r"\b(?:\d[ \-]?){13,19}\b",
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}
# Field names whose whole value is replaced.
FIELD_NAMES = (
    "password", "passwd", "secret", "token", "api_key", "apikey",
    "ssn", "social_security", "credit_card", "card_number",
    "phone", "mobile", "email", "id_card",
)
TYPES = tuple(PATTERNS)
PLACEHOLDER = "[REDACTED]"

_STRICT_ORDER = ("email", "id_card", "credit_card", "phone", "ipv4")
_STRICT_PHONE = r"(?<!\d)(?!\d{4}-\d{2}-\d{2}(?!\d))(\+?\d[\d\s\-\(\)]{7,14}\d)(?!\d)"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _chosen(types: Sequence[str] | None, mode: str = "compat") -> list[tuple[str, str]]:
    if mode not in ("compat", "strict"):
        raise ValueError(f"unknown mode: {mode!r}")
    wanted = TYPES if types is None else tuple(types)
    unknown = set(wanted) - set(TYPES)
    if unknown:
        raise ValueError(f"unknown PII types: {sorted(unknown)}")
    order = TYPES if mode == "compat" else _STRICT_ORDER
    patterns = PATTERNS if mode == "compat" else PATTERNS | {"phone": _STRICT_PHONE}
    # (?U): digits, spaces and word boundaries are those of Unicode
    return [(name, "(?U)" + patterns[name]) for name in order if name in wanted]


# Cheap tests that any match must pass: an at sign, or a digit with six more characters of a number.
_EMAIL_HINT = "@"
_NUMBER_HINT = r"(?U)\d[\d\s\-\(\).]{6}"


def _hinted(text: Column, name: str) -> Column:
    return text.contains(_EMAIL_HINT) if name == "email" else text.rlike(_NUMBER_HINT)


def redact(text: Column | str, types: Sequence[str] | None = None, placeholder: str = PLACEHOLDER,
           mode: str = "compat") -> Column:
    """Text with every match replaced by the placeholder; null stays null.

    Most texts hold no personal data: one look for a hint spares them the
    patterns, of which the four number patterns share one.
    """
    out = _col(text)
    literal = placeholder.replace("\\", "\\\\").replace("$", "\\$")
    chosen = _chosen(types, mode)
    for hinted in ("email", "number"):
        patterns = [pattern for name, pattern in chosen if (name == "email") == (hinted == "email")]
        if not patterns:
            continue
        replaced = out
        for pattern in patterns:
            replaced = F.regexp_replace(replaced, pattern, literal)
        out = F.when(_hinted(out, hinted), replaced).otherwise(out)
    return out


def contains_pii(text: Column | str, types: Sequence[str] | None = None) -> Column:
    """True if any pattern matches; null gives false."""
    text = _col(text)
    chosen = dict(_chosen(types))
    hit = F.lit(False)
    if "email" in chosen:
        hit = hit | (_hinted(text, "email") & text.rlike(chosen.pop("email")))
    if chosen:
        any_number = F.lit(False)
        for pattern in chosen.values():
            any_number = any_number | text.rlike(pattern)
        hit = hit | (_hinted(text, "number") & any_number)
    return F.coalesce(hit, F.lit(False))


def find_pii(text: Column | str, types: Sequence[str] | None = None) -> Column:
    """Map of PII type -> matched strings on the original text; only types that match."""
    text = _col(text)
    none = F.array().cast("array<string>")
    entries: list[Column] = []
    for name, pattern in _chosen(types):
        group = 1 if name == "phone" else 0
        matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        entries += [F.lit(name), F.when(_hinted(text, name), matches).otherwise(none)]
    return F.map_filter(F.create_map(*entries), lambda _, found: F.size(found) > 0)


class _Rewrite:
    """Rebuilds a value of a known type."""

    def __init__(self, placeholder: str):
        self.placeholder = placeholder

    def text(self, column: Column) -> Column:
        return redact(column, placeholder=self.placeholder)

    def field(self, column: Column, field: T.StructField) -> Column:
        if field.name.lower() not in FIELD_NAMES:
            return self.value(column, field.dataType)
        return F.lit(self.placeholder)

    def value(self, column: Column, dtype: T.DataType, in_list: bool = False) -> Column:
        if isinstance(dtype, T.StringType):
            return self.text(column)
        if isinstance(dtype, T.StructType):
            rebuilt = F.struct(*[self.field(column.getField(f.name), f).alias(f.name) for f in dtype.fields])
            return F.when(column.isNotNull(), rebuilt)
        if isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
            return F.transform_values(column, lambda key, item: self.entry(key, item, dtype.valueType))
        if isinstance(dtype, T.ArrayType) and not in_list:
            return F.transform(column, lambda item: self.value(item, dtype.elementType, in_list=True))
        return column  # other types, lists inside lists and variants (redacted before) pass through

    def entry(self, key: Column, item: Column, dtype: T.DataType) -> Column:
        named = F.lower(key).isin(*FIELD_NAMES)
        if isinstance(dtype, T.StructType | T.MapType | T.ArrayType):
            # one type per map: a named entry of a nested type is emptied, not replaced by text
            return F.when(~named, self.value(item, dtype))
        text = self.text(item) if isinstance(dtype, T.StringType) else item.cast("string")
        return F.when(named, F.lit(self.placeholder)).otherwise(text)


def _has_variant(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_has_variant(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _has_variant(dtype.elementType)
    return isinstance(dtype, T.VariantType) or isinstance(dtype, T.MapType) and _has_variant(dtype.valueType)


def _json_redacted(text: Column, placeholder: str) -> Column:
    return redact_json_text(text, FIELD_NAMES, PATTERNS.values(), f"{_EMAIL_HINT}|{_NUMBER_HINT}", placeholder)


def _variants_redacted(column: Column, dtype: T.DataType, placeholder: str) -> Column:
    """A column that is or holds variants, redacted within as JSON of any shape; other columns as they are."""
    if not _has_variant(dtype):
        return column
    text = _json_redacted(F.to_json(column), placeholder)
    return F.try_parse_json(text) if isinstance(dtype, T.VariantType) else F.from_json(text, dtype)


def redact_record(df: DataFrame, columns: Sequence[str] | None = None, placeholder: str = PLACEHOLDER) -> DataFrame:
    """Redact a table by field name and by value, down through structs, maps and lists.

    A field with a listed name becomes the placeholder text whatever its type was.
    ``columns`` limits the rewrite to some top-level columns (default: all).
    """
    wanted = set(df.columns if columns is None else columns)
    rewrite = _Rewrite(placeholder)
    return df.select(*[
        (rewrite.field(_variants_redacted(F.col(f"`{f.name}`"), f.dataType, placeholder), f) if f.name in wanted else F.col(f"`{f.name}`")).alias(f.name)
        for f in df.schema.fields])


def redact_json(df: DataFrame, column: str, placeholder: str = PLACEHOLDER) -> DataFrame:
    """Redact a column of JSON texts, or of variants, of any shape, row by row.

    Named fields become the placeholder at any depth, other texts are redacted; lists inside lists, keys and
    numbers stay (numbers keep their value, not their spelling). Texts that are no JSON objects are redacted as
    plain text too.
    """
    is_variant = isinstance(df.schema[column].dataType, T.VariantType)
    own = F.col(f"`{column}`")
    text = _json_redacted(F.to_json(own) if is_variant else own, placeholder)
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))
    out = F.when(is_object, text).otherwise(redact(text, placeholder=placeholder))
    return df.withColumn(column, F.coalesce(F.try_parse_json(out), out.cast("variant")) if is_variant else out)
