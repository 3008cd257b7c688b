"""Fixed-point heights, content ids and texture byte costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from landfold.functions.geometry import col


def encode_height(h, rounding: str = "floor") -> tuple[Column, Column]:
    """Height as two bytes: whole metres and 1/256 metres."""
    scaled = col(h) * 256
    code = (F.floor(scaled) if rounding == "floor" else F.rint(scaled)).cast("int")
    return F.shiftright(code, 8), code.bitwiseAND(F.lit(255))


def decode_height(high, low) -> Column:
    return col(high) + col(low) / F.lit(256.0)


def content_id(*values) -> Column:
    """First sixteen hex digits of the SHA-256 of the values as a JSON array of strings."""
    return F.substring(F.sha2(F.to_json(F.array(*[col(v).cast("string") for v in values])), 256), 1, 16)


def mip_bytes(width, height) -> Column:
    """Bytes of a full RGBA mip chain: 4·max(1,w>>k)·max(1,h>>k) for every level."""
    w, h = col(width).cast("bigint"), col(height).cast("bigint")
    levels = F.floor(F.log2(F.greatest(w, h))).cast("int")
    one = F.lit(1).cast("bigint")

    def level(total, k):
        scale = F.pow(F.lit(2.0), k)
        side = lambda n: F.greatest(one, F.floor(n / scale).cast("bigint"))
        return total + side(w) * side(h) * 4

    return F.aggregate(F.sequence(F.lit(0), levels), F.lit(0).cast("bigint"), level)


def mib(value) -> Column:
    return F.round(col(value) / F.lit(1048576.0), 3)


def pct(part, whole) -> Column:
    return F.round(col(part) / F.nullif(col(whole).cast("double"), F.lit(0.0)) * 100, 2)


def ratio(part, whole, digits: int = 4) -> Column:
    return F.round(col(part) / F.nullif(col(whole).cast("double"), F.lit(0.0)), digits)
