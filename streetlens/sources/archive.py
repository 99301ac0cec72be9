"""Kept regions, sealed: AES-GCM with a key derived from a secret."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def derive_key(secret: bytes, context: bytes, salt: bytes = b"", size: int = 32) -> bytes:
    """HKDF with SHA-256."""
    root = hmac.new(salt or bytes(32), secret, hashlib.sha256).digest()
    out, block = b"", b""
    while len(out) < size:
        block = hmac.new(root, block + context + bytes([len(out) // 32 + 1]), hashlib.sha256).digest()
        out += block
    return out[:size]


def seal(rows: DataFrame, column: str, key: bytes, bound_to: str) -> DataFrame:
    """``column`` encrypted; the value of ``bound_to`` is authenticated with it, so rows can't be swapped. Each run draws new vectors."""
    return rows.withColumn(column, F.aes_encrypt(F.col(column).cast("binary"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.col(bound_to).cast("string").cast("binary")))


def unseal(rows: DataFrame, column: str, key: bytes, bound_to: str) -> DataFrame:
    """The reverse; a wrong key or a changed row is an error."""
    return rows.withColumn(column, F.aes_decrypt(F.col(column), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.col(bound_to).cast("string").cast("binary")))
