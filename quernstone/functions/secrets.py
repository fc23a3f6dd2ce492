"""Blind indexes and encrypted fields, in built-in functions: no key leaves the plan's literals."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def hmac_sha256(value: Column, key: str) -> Column:
    """HMAC-SHA256 of a string as lowercase hex: two SHA-256 over the padded key, which is a constant."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > BLOCK else raw).ljust(BLOCK, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    inside = F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256)
    return F.sha2(F.concat(outer, F.unhex(inside)), 256)


def encrypted(value: Column, key: bytes, key_id: str = "default") -> Column:
    """`v1:key id:iv:tag:text` in hex, AES-256-GCM with an iv of 12 bytes and a tag of 16."""
    packed = F.lower(F.hex(F.aes_encrypt(value, F.lit(key), F.lit("GCM"))))  # iv, text, tag
    laid = lambda x: F.concat_ws(":", F.lit("v1"), F.lit(key_id), F.substr(x, F.lit(1), F.lit(24)), F.substr(x, F.length(x) - 31, F.lit(32)), F.substr(x, F.lit(25), F.length(x) - 56))
    # each evaluation has an iv of its own, so it must be one
    return F.when(value.isNotNull(), F.element_at(F.transform(F.array(packed), laid), 1))


def decrypted(payload: Column, key: bytes) -> Column:
    """The text of a payload; null for what isn't one, or was written with another key."""
    part = F.split(payload, ":")
    packed = F.unhex(F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(4)), F.get(part, F.lit(3))))
    text = F.try_aes_decrypt(packed, F.lit(key), F.lit("GCM")).cast("string")
    return F.when((F.size(part) == 5) & (F.get(part, F.lit(0)) == "v1"), text)


def decrypted_or_plain(payload: Column, plain: Column, key: bytes) -> Column:
    return F.when(F.coalesce(payload, F.lit("")) != "", decrypted(payload, key)).otherwise(plain)
