"""Random draws as pure functions of a row key.

``rand(seed)`` depends on partitioning and is re-drawn when a lost task is run
again; a hash of (key, salt) is not, so results survive executor loss and are
the same on any layout.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
from pyspark.sql import Column, functions as F


def _as_col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def hash_hex(*parts) -> Column:
    """md5 of the parts joined by ':' (32 hex digits, fixed width, sortable)."""
    return F.md5(F.concat_ws(":", *[_as_col(p).cast("string") for p in parts]))


def det_rand(key, *salt) -> Column:
    """Uniform double in [0, 1) drawn from the key and the salt."""
    return F.conv(F.substring(hash_hex(key, *salt), 1, 8), 16, 10).cast("double") / 4294967296.0


def det_index(key, salt, n) -> Column:
    """Uniform integer in [0, n)."""
    return F.floor(det_rand(key, salt) * n).cast("long")


def drawn_index(key: str | None, salt: str, n: int) -> int:
    """``det_index`` of one row."""
    digest = md5((salt if key is None else f"{key}:{salt}").encode()).hexdigest()
    return int(int(digest[:8], 16) / 4294967296.0 * n)


def symbol_stream(key: str | None, salt: str, n: int, symbols: int) -> np.ndarray:
    """Numbers of ``n`` symbols out of ``symbols``, drawn uniformly, for one text.

    The hex digits of a row of digests stand for symbols, every symbol having the
    same number of digits; digits left over are dropped. One digest so serves
    about 30 characters. With digits to drop, spare digests are drawn; should even
    those not do, the first symbol fills up.
    """
    share = 16 // symbols
    exact = share * symbols == 16
    blocks = max(-(-n // (32 if exact else 28)) + (0 if exact else 1), 1)
    prefix = (f"{salt}:" if key is None else f"{key}:{salt}:").encode()
    digests = np.frombuffer(b"".join([md5(b"%b%d" % (prefix, b)).digest() for b in range(1, blocks + 1)]), np.uint8)
    digits = np.empty(2 * len(digests), np.uint8)
    digits[0::2], digits[1::2] = digests >> 4, digests & 15
    drawn = (digits if exact else digits[digits < share * symbols])[:n] // share
    return drawn if len(drawn) == n else np.concatenate([drawn, np.zeros(n - len(drawn), np.uint8)])
