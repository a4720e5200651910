"""Hash buckets and digests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the 64-bit FNV-1a hash: offset basis halves and the low part
# of the prime 2^40 + 0x1b3.
FNV_BASIS_HIGH = 0xCBF29CE4
FNV_BASIS_LOW = 0x84222325
FNV_PRIME_LOW = 0x1B3


def fnv1a64(text: Column) -> Column:
    """Unsigned 64-bit FNV-1a of the UTF-8 bytes, as decimal(20,0).

    ANSI arithmetic has no wrapping product, so the state is kept as two 32-bit
    limbs: multiplying by 2^40 + p shifts the low limb into the high one.
    """
    digits = F.hex(F.encode(text, "UTF-8"))
    bytes_ = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(digits) - 1, F.lit(1)), F.lit(2)),
        lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("bigint"),
    )
    mask = F.lit(0xFFFFFFFF)
    start = F.struct(F.lit(FNV_BASIS_HIGH).cast("bigint").alias("hi"), F.lit(FNV_BASIS_LOW).cast("bigint").alias("lo"))

    def step(state: Column, byte: Column) -> Column:
        low = state["lo"].bitwiseXOR(byte)
        product = low * FNV_PRIME_LOW
        carry = F.shiftrightunsigned(product, 32)
        high = state["hi"] * FNV_PRIME_LOW + carry + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(mask).alias("hi"), product.bitwiseAND(mask).alias("lo"))

    def joined(state: Column) -> Column:
        return state["hi"].cast("decimal(20,0)") * F.lit(4294967296).cast("decimal(11,0)") + state["lo"].cast("decimal(20,0)")

    hashed = F.aggregate(bytes_, start, step, joined).cast("decimal(20,0)")
    basis = F.lit(str(FNV_BASIS_HIGH * 2**32 + FNV_BASIS_LOW)).cast("decimal(20,0)")
    return F.when(F.length(digits) > 0, hashed).otherwise(basis)


def fnv_bucket(text: Column, buckets: int) -> Column:
    return (fnv1a64(text) % buckets).cast("int")


def sha_bucket(text: Column, buckets: int) -> Column:
    """First eight bytes of sha256, big-endian, modulo ``buckets``."""
    head = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % buckets).cast("int")


def key_fingerprint(parts: dict[str, Column]) -> Column:
    """sha256 over ``name=value`` entries joined by the unit separator."""
    entries = [F.concat(F.lit(f"{n}="), c.cast("string")) for n, c in parts.items()]
    return F.sha2(F.concat_ws("\u001f", *entries), 256)


# Fixed values of the split policy: salt, and percentages of the first two of
# the three splits (the sealed audit takes the rest).
SPLIT_SALT = "gt-split-v1"
SPLIT_DEVELOPMENT_PCT = 55
SPLIT_CALIBRATION_PCT = 20


def split_of_bucket(bucket: Column) -> Column:
    return (
        F.when(bucket < SPLIT_DEVELOPMENT_PCT, "development")
        .when(bucket < SPLIT_DEVELOPMENT_PCT + SPLIT_CALIBRATION_PCT, "calibration")
        .otherwise("sealed_audit")
    )


def split_of_family(family: Column, salt: str = SPLIT_SALT) -> Column:
    """Split of a shape family: a function of the salted name alone."""
    return split_of_bucket(fnv_bucket(F.concat(F.lit(salt + "/"), family), 100))
