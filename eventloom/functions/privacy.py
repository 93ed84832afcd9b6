"""Redaction and pseudonyms for request data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.text import strip

# Key parts whose values are hidden, the mark, and the URL rule.
SENSITIVE_KEY_PARTS = (
    "authorization",
    "cookie",
    "password",
    "secret",
    "token",
    "jwt",
    "database_url",
    "redis_url",
)
REDACTED = "[redacted]"
URL_PASSWORD = r"(://[^:/@\s]+:)([^@\s]+)(@)"
KEY_NAMESPACE = "rate-limit"

_SHA256_BLOCK = 64


def is_sensitive_name(name: str) -> bool:
    return any(part in name.lower() for part in SENSITIVE_KEY_PARTS)


def is_sensitive_key(key: Column) -> Column:
    hit = F.lit(False)
    for part in SENSITIVE_KEY_PARTS:
        hit = hit | F.lower(key).contains(part)
    return hit


def mask_url_password(text: Column) -> Column:
    return F.regexp_replace(text, URL_PASSWORD, f"$1{REDACTED}$3")


def _redacted(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return mask_url_password(value)
    if isinstance(kind, T.MapType):
        def entry(k: Column, v: Column) -> Column:
            clean = _redacted(v, kind.valueType)
            name = k if isinstance(kind.keyType, T.StringType) else k.cast("string")
            if isinstance(kind.valueType, T.StringType):
                return F.when(is_sensitive_key(name), F.lit(REDACTED)).otherwise(clean)
            return F.when(~is_sensitive_key(name), clean)

        return F.transform_values(value, entry)
    if isinstance(kind, T.StructType):
        fields = [_redacted_field(value.getField(f.name), f).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _redacted_field(value: Column, field: T.StructField) -> Column:
    if is_sensitive_name(field.name):
        return F.lit(REDACTED)
    return _redacted(value, field.dataType)


def redact(df: DataFrame) -> DataFrame:
    """Hide sensitive columns, fields and map values at any depth and mask passwords inside URLs.

    Only names decide inside maps and structs; array items are left as they are.
    A sensitive map entry whose values are not text becomes null, since a map has one value type.
    """
    return df.select(*[_redacted_field(F.col(f"`{f.name}`"), f).alias(f.name) for f in df.schema.fields])


def normalise_identifier(identifier: Column) -> Column:
    return F.lower(strip(identifier))


def hmac_sha256(message: Column, secret: str) -> Column:
    """Hex HMAC-SHA256 of a text column, from Spark's own SHA-256."""
    if not secret:
        raise ValueError("a secret is required")
    import hashlib

    key = secret.encode("utf-8")
    if len(key) > _SHA256_BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_SHA256_BLOCK, b"\0")
    inner = bytearray(b ^ 0x36 for b in key)
    outer = bytearray(b ^ 0x5C for b in key)
    digest = F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(digest)), 256)


def pseudonym(identifier: Column, secret: str) -> Column:
    """Keyed hash of an identifier, the same for all its spellings in case and outer whitespace."""
    return hmac_sha256(normalise_identifier(identifier), secret)


def user_key(scope: Column, user_id: Column) -> Column:
    return F.concat_ws(":", F.lit(KEY_NAMESPACE), scope, F.lit("user"), user_id.cast("string"))


def identifier_key(scope: Column, kind: str, identifier: Column, secret: str) -> Column:
    return F.concat_ws(":", F.lit(KEY_NAMESPACE), scope, F.lit(kind), pseudonym(identifier, secret))


def global_key(scope: Column) -> Column:
    return F.concat_ws(":", F.lit(KEY_NAMESPACE), scope, F.lit("global"))
