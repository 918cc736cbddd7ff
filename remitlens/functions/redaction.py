"""Redaction of text and of keyed values with built-in regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Redaction patterns and their replacements, in application order.
# Addresses are themselves long tokens, so they come before the token rule.
TEXT_RULES = [
    (r"G[A-Z0-9]{55}", "G****[REDACTED]"),
    (r"S[A-Z0-9]{55}", "S****[REDACTED_SECRET]"),
    (r"eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*", "[REDACTED_JWT]"),
    (r"\b[A-Za-z0-9_-]{32,}\b", "[REDACTED_KEY]"),
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "****@[REDACTED]"),
    (r"(\+\d{1,3})\d{7,}", "$1****[REDACTED]"),
    (r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", "****-****-****-[REDACTED]"),
]
SSN_RULE = (r"\b\d{3}-\d{2}-\d{4}\b", "***-**-[REDACTED]")
MNEMONIC_RULES = [
    (r"\b(?:[a-z]+ ){23}[a-z]+\b", "[24_WORD_MNEMONIC_REDACTED]"),
    (r"\b(?:[a-z]+ ){11}[a-z]+\b", "[12_WORD_MNEMONIC_REDACTED]"),
]
SENSITIVE_KEY = r"(?i)password|secret|token|key|auth|credential|private|seed|mnemonic|jwt|bearer|signature"
SENSITIVE_FIELDS = ["password", "api_key", "secret", "token", "authorization"]


def redact_text(col: Column, ssn: bool = True, mnemonics: bool = True) -> Column:
    """Apply the rules in order. The mnemonic rules match any 12 or 24 lower-case
    words in a row, which ordinary prose contains too: turn them off for prose."""
    rules = list(TEXT_RULES)
    if ssn:
        rules.append(SSN_RULE)
    if mnemonics:
        rules = MNEMONIC_RULES + rules
    for pattern, replacement in rules:
        col = F.regexp_replace(col, pattern, replacement)
    return col


def redact_map(col: Column) -> Column:
    """Values of sensitive keys vanish, all other values go through the text rules."""
    return F.transform_values(
        col, lambda k, v: F.when(k.rlike(SENSITIVE_KEY), F.lit("[REDACTED]")).otherwise(redact_text(v))
    )


def redact_nested(col: Column, kind: T.DataType, key: str = "") -> Column:
    """The same for structs, arrays and maps of any depth, by their type.

    What stands under a sensitive key becomes "[REDACTED]", whatever its type;
    other text goes through the text rules; numbers and dates stay.
    """
    if re.search(SENSITIVE_KEY, key):
        return F.when(col.isNotNull(), F.lit("[REDACTED]"))
    if isinstance(kind, T.StructType):
        fields = [redact_nested(col[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields]
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: redact_nested(x, kind.elementType))
    if isinstance(kind, T.MapType):
        inner = kind.valueType
        if isinstance(inner, T.StringType):
            return redact_map(col)
        # a map has one value type: sensitive values vanish, the others are redacted inside
        return F.transform_values(col, lambda k, v: F.when(~k.rlike(SENSITIVE_KEY), redact_nested(v, inner)))
    return redact_text(col) if isinstance(kind, T.StringType) else col


def redact_columns(df: DataFrame) -> DataFrame:
    """Every column of a frame under ``redact_nested``."""
    return df.select(*[redact_nested(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


def drop_sensitive_fields(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Remove sensitive columns, and fields of that name one level down in structs."""
    names = names or SENSITIVE_FIELDS
    df = df.drop(*names)
    for field in df.schema.fields:
        if field.dataType.typeName() == "struct":
            inner = [n for n in names if n in field.dataType.fieldNames()]
            if inner and len(inner) < len(field.dataType.fieldNames()):
                df = df.withColumn(field.name, F.col(field.name).dropFields(*inner))
            elif inner:
                df = df.drop(field.name)
    return df
