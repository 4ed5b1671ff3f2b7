"""Column expressions of the log: sizes, checksums, key hashes and filter positions. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.model import ENTRY_OVERHEAD, PUT, RECORD_OVERHEAD, TOMBSTONE

_MASK = 0xFFFFFFFF
# fixed values of the 32-bit FNV-1a hash
FNV_SEED, FNV_PRIME = 2166136261, 16777619


def entry_size(k: Column, op: Column, v: Column) -> Column:
    """Bytes of an entry of the in-memory table; a tombstone has no value."""
    return (F.octet_length(k) + F.when(op == TOMBSTONE, 0).otherwise(F.octet_length(v)) + ENTRY_OVERHEAD).cast("long")


def record_size(k: Column, op: Column, v: Column) -> Column:
    """Bytes of a record of the log or of a segment."""
    return (F.octet_length(k) + F.when(op == TOMBSTONE, 0).otherwise(F.octet_length(v)) + RECORD_OVERHEAD).cast("long")


def _u32(n: Column) -> Column:
    """The four bytes of a number, the lowest first."""
    h = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(*(F.substring(h, at, 2) for at in (7, 5, 3, 1))))


def record_bytes(k: Column, op: Column, v: Column) -> Column:
    """A log record without its checksum: type, lengths, key, value."""
    key = F.encode(k, "UTF-8")
    value = F.when(op == TOMBSTONE, F.encode(F.lit(""), "UTF-8")).otherwise(F.encode(v, "UTF-8"))
    return F.concat(F.unhex(F.lpad(F.hex(op.cast("long")), 2, "0")), _u32(F.octet_length(key)), _u32(F.octet_length(value)), key, value)


def record_crc(k: Column, op: Column, v: Column) -> Column:
    """The checksum of a record."""
    return F.crc32(record_bytes(k, op, v))


def key_bytes(k: Column) -> Column:
    """The bytes of a key as an array of numbers."""
    h = F.hex(F.encode(k, "UTF-8"))
    at = F.when(F.length(h) > 0, F.sequence(F.lit(1), F.length(h), F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.substr(h, i, F.lit(2)), 16, 10).cast("long"))


def fnv1a(k: Column) -> Column:
    """32-bit FNV-1a of the key's bytes."""
    return F.aggregate(key_bytes(k), F.lit(FNV_SEED).cast("long"), lambda h, b: (h.bitwiseXOR(b) * FNV_PRIME).bitwiseAND(F.lit(_MASK)))


def one_at_a_time(k: Column) -> Column:
    """32-bit one-at-a-time hash of the key's bytes, with 0 replaced by 1."""

    def stir(h: Column, b: Column) -> Column:
        # x * 1025 is x + (x << 10)
        mixed = F.transform(F.array(((h + b) * 1025).bitwiseAND(F.lit(_MASK))), lambda x: x.bitwiseXOR(F.shiftright(x, 6)))
        return F.element_at(mixed, 1)

    def finish(h: Column) -> Column:
        steps = F.transform(F.array((h * 9).bitwiseAND(F.lit(_MASK))), lambda x: x.bitwiseXOR(F.shiftright(x, 11)))
        steps = F.transform(steps, lambda x: (x * 32769).bitwiseAND(F.lit(_MASK)))
        return F.element_at(F.transform(steps, lambda x: F.when(x == 0, F.lit(1).cast("long")).otherwise(x)), 1)

    return F.aggregate(key_bytes(k), F.lit(0).cast("long"), stir, finish)


def bloom_size(n: Column, bits_per_key: int) -> Column:
    """Bits of a filter for n keys, in whole bytes; an empty one is sized for 64 keys, and none has fewer than 64 bits."""
    bits = F.greatest(F.when(n == 0, 64).otherwise(n) * bits_per_key, F.lit(64)).cast("long")
    return F.shiftleft(F.shiftright(bits + 7, 3), 3)


def bloom_positions(h1: Column, h2: Column, n_bits: Column, n_hashes: int) -> Column:
    """The bit positions of a key."""
    if n_hashes < 1:
        return F.array().cast("array<bigint>")
    return F.transform(F.sequence(F.lit(0), F.lit(n_hashes - 1)), lambda i: (h1 + i.cast("long") * h2) % n_bits)


def op_name(op: Column) -> Column:
    return F.when(op.isNull(), "ABSENT").when(op == TOMBSTONE, "TOMBSTONE").when(op == PUT, "VALUE")
