"""Keyed digests as expressions: HMAC-SHA256, rolling hashes, placeholders, nonces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Lower-case hex HMAC-SHA256 of a string or binary column (RFC 2104 on ``sha2``)."""
    import hashlib

    key = hashlib.sha256(key).digest() if len(key) > _BLOCK else key
    pad = lambda b: F.lit(bytearray(x ^ b for x in key.ljust(_BLOCK, b"\0")))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def rolling_hash(key: bytes, scope: str, entity: Column, value: Column, as_of: int, window_hours: int) -> Column:
    """Digest of a value that changes with each window of ``window_hours``; ``as_of`` is epoch seconds, so results can be repeated."""
    bucket = as_of // (window_hours * 3600)
    return hmac_sha256(key, F.concat(F.lit(f"palimpsest:v1:rolling-hash:{scope}:{bucket}:"), entity, F.lit(":"), value))


def placeholder(key: bytes, prefix: str, nonce: Column, entity: Column, value: Column) -> Column:
    """``<PREFIX_ENTITY_nonce_digest>``; equal values of one nonce share it."""
    digest = hmac_sha256(key, F.concat(F.lit("palimpsest:v1:placeholder:"), nonce, F.lit(":"), entity, F.lit(":"), value))
    return F.concat(F.lit(f"<{prefix}_"), entity, F.lit("_"), nonce, F.lit("_"), F.substring(digest, 1, 16), F.lit(">"))


def nonce(seed: str, request_id: Column) -> Column:
    """Sixteen hex digits for a request."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(seed), request_id.cast("string")), 256), 1, 16)


def namespace(key: bytes, session_key: Column, policy_version: str) -> Column:
    """Stable nonce of a conversation, so its placeholders stay the same over turns."""
    return F.substring(hmac_sha256(key, F.concat(F.lit(f"palimpsest:v1:conversation:{policy_version}:"), session_key)), 1, 16)
