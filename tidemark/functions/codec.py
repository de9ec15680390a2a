"""Small codecs of the front ends: quoted bytes, base64, order-preserving keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ESCAPES = {"\a": "\\a", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v", "\\": "\\\\", '"': '\\"'}


def quoted(data: bytes) -> str:
    """Bytes as a double-quoted literal: printable text as it is, other characters and invalid bytes escaped."""
    out = []
    for char in data.decode("utf-8", "surrogateescape"):
        code = ord(char)
        if char in _ESCAPES:
            out.append(_ESCAPES[char])
        elif 0xDC80 <= code <= 0xDCFF:
            out.append(f"\\x{code - 0xDC00:02x}")
        elif char.isprintable():
            out.append(char)
        elif code < 0x80:
            out.append(f"\\x{code:02x}")
        else:
            out.append(f"\\u{code:04x}" if code < 0x10000 else f"\\U{code:08x}")
    return '"' + "".join(out) + '"'


def base64_line(column: str | Column) -> Column:
    """Base64 without line breaks."""
    return F.regexp_replace(F.base64(column), r"[\r\n]", "")


def text_key(column: str | Column) -> Column:
    """A string as a binary key, in code-point order."""
    return F.encode(column, "UTF-8")


def int_key(column: str | Column, prefix: str, width: int) -> Column:
    """A non-negative number as a key that sorts like the number."""
    return F.encode(F.format_string(f"{prefix}%0{width}d", column), "UTF-8")


def typed(rows: DataFrame, schema: str) -> DataFrame:
    """``key, value`` rows with JSON values as the columns of a schema; a value that doesn't parse gives nulls."""
    return rows.withColumn("_v", F.from_json(F.decode("value", "UTF-8"), schema)).select("key", "_v.*")
