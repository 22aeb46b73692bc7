"""Reproducible randomness: every draw is a hash of (seed, decision, row key).

Unlike ``rand(seed)`` the draws do not depend on partitioning, task retries or engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hex digits are 52 bits: the quotient is an exact double in [0, 1).
HEX_DIGITS = 13
SCALE = float(1 << (4 * HEX_DIGITS))


def uniform(seed: int, salt: str, *keys: Column | str) -> Column:
    """Uniform double in [0, 1) for the decision ``salt`` of the row named by ``keys``."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[p.cast("string") for p in parts])
    digits = F.substring(F.md5(text), 1, HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(SCALE)


def randint(u: Column, low: Column, high: Column) -> Column:
    """Integer in [low, high], both ends included."""
    return (low + F.floor(u * (high - low + F.lit(1)))).cast("int")
