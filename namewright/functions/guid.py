"""GUID expressions: UUIDv5 in SQL, text normalisation, display.

A GUID is 32 lower-case hex digits (string order is byte order) in results and
16 bytes while data is shuffled. The same UUIDv5 text runs on other engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name spaces that any compatible producer must share.
NAMESPACES = {
    "function": "0192a17961ac7cef88ed012296e9492f",
    "basic_block": "0192a1787a5f793686533cbaa7d6afe7",
    "symbol": "6d5ace5a00504e71815e5536e9e61484",
    "child_call": "7e3d0b4056dd4b77a8259c75b0b607c5",
    "parent_call": "dc0e3d9d72ea46df81fcebe4295f0977",
    "symbol_child_call": "18811911ca5d4d97a1c3dd526ae818a5",
    "symbol_parent_call": "e4b07ff0e7984427b533174aebda4858",
    "data_const": "db056d717d644660a937aeb6e8136af2",
}
NIL = "0" * 32


def uuid5(namespace: str, payload_hex: Column) -> Column:
    """UUIDv5 as 32 hex digits. payload_hex: the payload's bytes in hex; null gives null."""
    digest = F.sha1(F.unhex(F.concat(F.lit(NAMESPACES[namespace]), payload_hex)))

    def shown(d: Column) -> Column:
        variant = F.translate(F.substring(d, 17, 1), "0123456789abcdef", "89ab" * 4)
        return F.concat(F.substring(d, 1, 12), F.lit("5"), F.substring(d, 14, 3), variant, F.substring(d, 18, 15))

    return bound(digest, shown)


def bound(column: Column, use: Callable[[Column], Column]) -> Column:
    """use(column) with the column named once in the plan, however often use refers to it."""
    return F.get(F.transform(F.array(column), use), F.lit(0))


def text_hex(text: Column) -> Column:
    """The UTF-8 bytes of a text in hex."""
    return F.hex(F.encode(text, "utf-8"))


def function_guid(payload_hex: Column) -> Column:
    """GUID of a function from its concatenated block GUIDs."""
    return uuid5("function", payload_hex)


def block_guid(payload_hex: Column) -> Column:
    """GUID of a basic block from its normalised bytes."""
    return uuid5("basic_block", payload_hex)


def symbol_guid(name: Column) -> Column:
    """GUID of a symbol name."""
    return uuid5("symbol", text_hex(name))


def child_call(function: Column) -> Column:
    """Constraint: calls this function."""
    return uuid5("child_call", function)


def parent_call(function: Column) -> Column:
    """Constraint: is called by this function."""
    return uuid5("parent_call", function)


def symbol_child_call(name: Column) -> Column:
    """Constraint: calls the function of this name."""
    return uuid5("symbol_child_call", symbol_guid(name))


def symbol_parent_call(name: Column) -> Column:
    """Constraint: is called by the function of this name."""
    return uuid5("symbol_parent_call", symbol_guid(name))


def symbol_calls(name: Column) -> Column:
    """Both of them as a struct (child, parent); the name's own GUID is made once."""
    return bound(symbol_guid(name), lambda s: F.struct(uuid5("symbol_child_call", s).alias("child"), uuid5("symbol_parent_call", s).alias("parent")))


def function_calls(function: Column) -> Column:
    """child_call() and parent_call() as a struct (child, parent)."""
    return bound(function, lambda f: F.struct(child_call(f).alias("child"), parent_call(f).alias("parent")))


def data_const(payload_hex: Column) -> Column:
    """Constraint: refers to these constant bytes."""
    return uuid5("data_const", payload_hex)


def dashed(guid: Column) -> Column:
    """8-4-4-4-12 form, for sinks."""
    spans = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(guid, start, n) for start, n in spans])


def guid_bytes(text: Column) -> Column:
    """The 16 bytes of a GUID text however it is written, else null.

    Letter case and any characters that are no hex digits do not matter. Text
    with another number of hex digits is searched for the usual grouped form, so
    that a prefix with letters such as 'urn:uuid:' does no harm; without one the
    result is null. Null and the nil GUID give null: they are never counted.
    Plain 32-digit text, nearly all there is, skips the regular expressions.
    """
    grouped = "(?<![0-9A-Fa-f])" + "[^0-9A-Fa-f]?".join(f"[0-9A-Fa-f]{{{n}}}" for n in (8, 4, 4, 4, 12)) + "(?![0-9A-Fa-f])"
    stripped = F.regexp_replace(text, "[^0-9A-Fa-f]", "")
    digits = F.when(F.length(text) == 32, text).when(F.length(stripped) == 32, stripped).otherwise(
        F.regexp_replace(F.regexp_extract(text, grouped, 0), "[^0-9A-Fa-f]", "")
    )
    raw = F.unhex(digits)
    return F.when((F.octet_length(raw) == 16) & (raw != F.lit(bytes(16))), raw)


def guid_hex(raw: Column) -> Column:
    """16 bytes as 32 lower-case hex digits."""
    return F.lower(F.hex(raw))
