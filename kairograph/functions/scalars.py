"""Scalar rules at the edge of the API: timestamps, ids, model names, vectors."""

from __future__ import annotations

import datetime as dt
import os
import re
import struct
import time
from collections.abc import Sequence

from kairograph.errors import DimMismatch, InvalidId, InvalidModelName, InvalidTimestamp
from kairograph.types import OPEN

_CANONICAL = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}Z", re.ASCII)
_SECONDS = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", re.ASCII)
_MODEL = re.compile(r"[a-z][a-z0-9_]{0,47}")
#: Crockford's base 32 (fixed value).
_BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def normalize(text: str) -> str:
    """Canonical form of a timestamp text, or InvalidTimestamp."""
    if _SECONDS.fullmatch(text):
        text = text[:-1] + ".000000Z"
    if not _CANONICAL.fullmatch(text):
        raise InvalidTimestamp(value=text, reason="not of the form YYYY-MM-DDTHH:MM:SS.ffffffZ")
    try:
        dt.datetime.strptime(text, "%Y-%m-%dT%H:%M:%S.%fZ")
    except ValueError as error:
        raise InvalidTimestamp(value=text, reason=str(error)) from None
    return text


def to_canonical(value: str | dt.datetime | None) -> str:
    """None is the open end; a datetime must know its zone."""
    if value is None:
        return OPEN
    if isinstance(value, str):
        return normalize(value)
    if not isinstance(value, dt.datetime):
        raise InvalidTimestamp(value=str(value), reason="a date has no time of day")
    if value.tzinfo is None:
        raise InvalidTimestamp(value=str(value), reason="it has no time zone")
    return value.astimezone(dt.UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ").zfill(27)


def from_canonical(text: str) -> dt.datetime | None:
    if normalize(text) == OPEN:
        return None
    return dt.datetime.strptime(normalize(text), "%Y-%m-%dT%H:%M:%S.%fZ").replace(tzinfo=dt.UTC)


def check_id(id_: str) -> str:
    if not id_ or "|" in id_:
        raise InvalidId(id=id_)
    return id_


def check_model(name: str) -> str:
    if not _MODEL.fullmatch(name):
        raise InvalidModelName(name=name)
    return name


def generate_id() -> str:
    """A ULID: 48 bits of milliseconds, 80 random bits, sortable as text."""
    number = int(time.time() * 1000) << 80 | int.from_bytes(os.urandom(10))
    return "".join(_BASE32[number >> shift & 31] for shift in range(125, -1, -5))


def is_ulid(text: str) -> bool:
    return len(text) == 26 and text[0] in "01234567" and all(c in _BASE32 for c in text.upper())


def encode_vector(vector: Sequence[float]) -> bytes:
    """Packed little-endian 32-bit floats."""
    return struct.pack(f"<{len(vector)}f", *vector)


def coerce_vector(value: bytes | Sequence[float], dim: int, model: str = "") -> list[float]:
    """Packed floats or a sequence of numbers, of ``dim`` entries."""
    if isinstance(value, str):
        raise TypeError("a vector is bytes or numbers, not text")
    if isinstance(value, (bytes, bytearray, memoryview)):
        raw = bytes(value)
        if len(raw) != 4 * dim:
            raise DimMismatch(got=len(raw) // 4, expected=dim, model=model)
        return list(struct.unpack(f"<{dim}f", raw))
    if len(value) != dim:
        raise DimMismatch(got=len(value), expected=dim, model=model)
    return [float(x) for x in value]


class Clock:
    """Strictly increasing microseconds, never below a floor."""

    def __init__(self, floor: str | None = None):
        self._last = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
        if floor:
            self.raise_floor(floor)

    def raise_floor(self, text: str) -> None:
        self._last = max(self._last, dt.datetime.strptime(normalize(text), "%Y-%m-%dT%H:%M:%S.%fZ").replace(tzinfo=dt.UTC))

    def _time(self) -> dt.datetime:
        return dt.datetime.now(dt.UTC)

    def now(self) -> str:
        self._last = max(self._time(), self._last + dt.timedelta(microseconds=1))
        return to_canonical(self._last)


class FakeClock(Clock):
    """A clock that stands where it was set and steps a microsecond a call."""

    def __init__(self, at: str):
        super().__init__()
        self.set(at)

    def set(self, at: str) -> None:
        self._at = dt.datetime.strptime(normalize(at), "%Y-%m-%dT%H:%M:%S.%fZ").replace(tzinfo=dt.UTC)

    def _time(self) -> dt.datetime:
        return self._at
