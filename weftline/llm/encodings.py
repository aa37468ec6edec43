"""Encodings by which text was read or written, as inverse mappings of short runs."""

from __future__ import annotations

import re
from functools import lru_cache

CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")

#: Encodings that pages were read in by mistake. Single-byte ones keep undefined bytes
#: as the control character of that number, as browsers do.
SINGLE = (
    "cp1252", "latin-1", "cp1251", "koi8-r", "mac-roman", "cp437", "iso8859-2", "iso8859-15", "cp1253", "iso8859-7",
    "cp1254", "iso8859-9", "cp1250", "cp850",
)
DOUBLE = ("gb18030", "shift_jis", "cp932", "euc_jp")
#: Encodings that pages were written in, besides UTF-8.
WRITTEN = (
    "cp1252", "cp1251", "koi8-r", "iso8859-2", "cp1254", "cp1253", "shift_jis", "euc_jp", "gb18030", "mac-roman", "cp437",
    "iso8859-15", "cp1250", "cp850",
)


class _Bytes(dict):
    """Code point to byte of a single-byte encoding, as a translation table; others go to U+FFFF."""

    def __missing__(self, point: int) -> int:
        return 0xFFFF


@lru_cache(maxsize=None)
def byte_of(name: str) -> _Bytes:
    out = _Bytes()
    for b in range(256):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(ord(c), b)
    return out


def to_bytes(run: str, read_as: str) -> bytes | None:
    """The bytes that give ``run`` when read as ``read_as``; None if none do."""
    try:
        return run.encode(read_as) if read_as in DOUBLE else run.translate(byte_of(read_as)).encode("latin-1")
    except UnicodeEncodeError:
        return None


def to_text(data: bytes, written_as: str, loose: bool = False) -> str | None:
    """``data`` read strictly; undefined bytes and, unless ``loose``, control characters make it None."""
    try:
        text = data.decode(written_as)
    except UnicodeDecodeError:
        return None
    if loose:
        return text
    return None if CONTROL.search(text) else text
