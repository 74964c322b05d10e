"""AES-256-GCM text encryption with Spark's own functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(password: str) -> Column:
    return F.unhex(F.lit(hashlib.sha256(password.encode()).hexdigest()))


def encrypt(text: Column, password: str) -> Column:
    """Base64 of a random 12-byte nonce, the cipher text and its tag; null is encrypted as an empty text."""
    return F.base64(F.aes_encrypt(F.coalesce(text, F.lit("")).cast("binary"), _key(password), F.lit("GCM")))


def decrypt(text: Column, password: str) -> Column:
    """The text again; null if there is no cipher text, empty if the password or the text is wrong."""
    raw = F.try_to_binary(text, F.lit("base64"))
    plain = F.try_aes_decrypt(raw, _key(password), F.lit("GCM")).cast("string")
    return F.when(F.length(raw) >= 13, F.coalesce(plain, F.lit("")))
