"""Keyed hashes of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_sha256(text: Column, key: str) -> Column:
    """HMAC-SHA256 of a text under a key, in hex: two rounds of SHA-256 over the padded key."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    pad = lambda byte: F.unhex(F.lit(bytes(b ^ byte for b in raw).hex()))
    inner = F.sha2(F.concat(pad(0x36), text.cast("binary")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)
