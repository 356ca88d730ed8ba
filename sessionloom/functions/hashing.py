"""Keyed hashing built from the native SHA-256 function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SALT_BYTES = 32
_BLOCK_BYTES = 64


def check_salt(salt: bytes) -> bytes:
    if len(salt) != SALT_BYTES:
        raise ValueError(f"privacy salt must be {SALT_BYTES} bytes")
    return salt


def _pad(salt: bytes, fill: int) -> Column:
    block = check_salt(salt).ljust(_BLOCK_BYTES, b"\0")
    return F.lit(bytearray(byte ^ fill for byte in block))


def hmac_sha256(message: Column, salt: bytes) -> Column:
    """Hex HMAC-SHA-256 of a text column under a 32-byte secret (RFC 2104)."""
    inner = F.sha2(F.concat(_pad(salt, 0x36), message.cast("binary")), 256)
    return F.sha2(F.concat(_pad(salt, 0x5C), F.unhex(inner)), 256)


def fingerprint(message: Column, salt: bytes) -> Column:
    """Installation-specific identifier that does not reveal the message."""
    return F.concat(F.lit("hmac-sha256:"), hmac_sha256(message, salt))
