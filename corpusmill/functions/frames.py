"""Wire frames: magic byte, schema id (4 bytes, big end first), message indexes, payload.

Indexes are zig-zag varints: how many there are, then each; the one index 0 is the single byte 00. A varint has seven bits a
byte, the lowest first, and its last byte is below 128; it has ten bytes at most and 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The most bytes of a varint, and the bits before its last one.
LONGEST, LAST = 10, 63


def _shift(name: str, value: Column, by: Column) -> Column:
    return F.call_function(name, value, by.cast("int"))


def varint(value: Column) -> Column:
    """The digits of a number's zig-zag varint."""
    number = value.cast("long")
    zigzag = F.shiftleft(number, 1).bitwiseXOR(F.shiftright(number, LAST))
    rest = lambda i: _shift("shiftrightunsigned", zigzag, 7 * i)
    places = F.filter(F.sequence(F.lit(0), F.lit(LONGEST - 1)), lambda i: (i == 0) | (rest(i) != 0))
    more = lambda i: F.when(i < F.size(places) - 1, F.lit(128).cast("long")).otherwise(F.lit(0).cast("long"))
    return F.array_join(F.transform(places, lambda i: F.lpad(F.hex(rest(i).bitwiseAND(F.lit(127).cast("long")).bitwiseOR(more(i))), 2, "0")), "")


def encoded_path(schema_id: Column, indexes: Column, payload: Column) -> Column:
    """A frame with an array of message indexes, from the outermost message inwards."""
    head = F.concat(F.lit("00"), F.lpad(F.hex(schema_id.cast("long")), 8, "0"))
    listed = F.concat(varint(F.size(indexes)), F.array_join(F.transform(indexes, varint), ""))
    place = F.when((F.size(indexes) == 1) & (F.get(indexes, F.lit(0)) == 0), "00").otherwise(listed)
    return F.concat(F.unhex(F.concat(head, place)), payload)


def encoded(schema_id: Column, index: Column, payload: Column) -> Column:
    """A frame with the index of a message that isn't inside another."""
    return encoded_path(schema_id, F.array(index.cast("long")), payload)


def _numbers(digits: Column, first: Column, most: Column, wanted: Column) -> Column:
    """numbers, used, bad: the wanted count of varints from the byte at place first (from 0) on, of most bytes there at most.

    The fold carries the number so far and its shift from byte to byte.
    """
    there = F.least(most, F.length(digits) / 2 - first).cast("int")
    none = F.array().cast("array<int>")
    byte = lambda i: F.conv(F.substr(digits, (2 * (first + i) + 1).cast("int"), F.lit(2)), 16, 10).cast("long")
    bytes_ = F.transform(F.when(there > 0, F.sequence(F.lit(0), there - 1)).otherwise(none), byte)
    zero = F.struct(F.lit(0).cast("long").alias("value"), F.lit(0).alias("shift"), F.array().cast("array<bigint>").alias("numbers"), F.lit(0).alias("used"), F.lit(False).alias("bad"))

    def step(s: Column, b: Column) -> Column:
        value = s["value"].bitwiseOR(_shift("shiftleft", b.bitwiseAND(F.lit(127).cast("long")), s["shift"]))
        ends = b < 128
        signed = F.shiftrightunsigned(value, 1).bitwiseXOR(-value.bitwiseAND(F.lit(1).cast("long")))
        after = F.struct(
            F.when(ends, F.lit(0).cast("long")).otherwise(value).alias("value"), F.when(ends, F.lit(0)).otherwise(s["shift"] + 7).alias("shift"),
            F.when(ends, F.concat(s["numbers"], F.array(signed))).otherwise(s["numbers"]).alias("numbers"), (s["used"] + 1).alias("used"), (s["shift"] >= LAST) & (b > 1),
        )
        return F.when(s["bad"] | (F.size(s["numbers"]) >= wanted), s).otherwise(after.cast("struct<value: bigint, shift: int, numbers: array<bigint>, used: int, bad: boolean>"))

    return F.aggregate(bytes_, zero, step)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often then uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def decoded(frame: Column) -> Column:
    """schema_id, index (the first; null if there is none), indexes, payload; null for a frame that is too short, has another
    magic byte, or indexes that are cut off or too long."""

    def row(digits: Column, indexes: Column, used: Column) -> Column:
        schema = F.conv(F.substring(digits, 3, 8), 16, 10).cast("long")
        payload = F.unhex(F.substr(digits, (2 * (5 + used) + 1).cast("int")))
        return F.struct(schema.alias("schema_id"), F.get(indexes, F.lit(0)).alias("index"), indexes.alias("indexes"), payload.alias("payload"))

    def listed(digits: Column, count: Column) -> Column:
        n = F.greatest(F.get(count["numbers"], F.lit(0)), F.lit(0).cast("long"))  # fewer than none: none
        most = F.least(n, F.length(digits).cast("long")) * LONGEST
        read = _let(n, lambda n: _let(_numbers(digits, 5 + count["used"], most, n), lambda own: F.when(~own["bad"] & (F.size(own["numbers"]) >= n), row(digits, own["numbers"], count["used"] + own["used"]))))
        return F.when(~count["bad"] & (F.size(count["numbers"]) == 1), read)

    def sound(digits: Column) -> Column:
        first = F.substring(digits, 11, 2)
        several = _let(_numbers(digits, F.lit(5), F.lit(LONGEST), F.lit(1)), lambda count: listed(digits, count))
        return F.when(first == "00", row(digits, F.array(F.lit(0).cast("long")), F.lit(1))).when(first != "", several)

    return _let(F.hex(frame), lambda digits: F.when(digits.startswith("00"), sound(digits)))
