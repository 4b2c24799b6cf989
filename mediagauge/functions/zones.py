"""Versioned tables of the offset changes of time zones, and vectorised local-to-UTC conversion."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import lru_cache
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo

import numpy as np

#: Years whose offset changes are tabulated; the last offset holds beyond them.
FIRST_YEAR, LAST_YEAR = 1900, 2100
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


@lru_cache(1)
def zone_version() -> str:
    """The release of the time-zone data in use, such as 2026a."""
    for root in TZPATH:
        for name, at in (("tzdata.zi", 2), ("+VERSION", 0)):
            path = Path(root, name)
            if path.exists():
                words = path.open(errors="replace").readline().split()
                if len(words) > at:
                    return words[at]
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


def _offset(zone: ZoneInfo, second: int) -> int:
    return int((_EPOCH + timedelta(seconds=second)).astimezone(zone).utcoffset().total_seconds())


@lru_cache(512)
def transitions(name: str) -> tuple[np.ndarray, np.ndarray] | None:
    """UTC seconds at which the offset of a zone changes, and the offset before the first and after each.

    None for an unknown zone. Days are probed, then each change is bisected to the second.
    """
    try:
        zone = ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None
    day = 86_400
    first = int((datetime(FIRST_YEAR, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds())
    last = int((datetime(LAST_YEAR, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds())
    at, offsets = [], [_offset(zone, first)]
    for t in range(first + day, last, day):
        if _offset(zone, t) != offsets[-1]:
            lo, hi = t - day, t
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if _offset(zone, mid) == offsets[-1] else (lo, mid)
            at.append(hi)
            offsets.append(_offset(zone, t))
    return np.array(at, dtype=np.int64), np.array(offsets, dtype=np.int64)


def local_to_utc(name: str, local: np.ndarray) -> np.ndarray | None:
    """UTC seconds of local wall-clock seconds in a zone; None for an unknown zone.

    A repeated local time means its first occurrence, a skipped one is read with the offset
    before the change: in both cases the offset before the change applies until its local end.
    """
    table = transitions(name)
    if table is None:
        return None
    at, offsets = table
    # The earlier offset holds up to the later of the two wall clocks at the change.
    until = at + np.maximum(offsets[:-1], offsets[1:])
    return local - offsets[np.searchsorted(until, local, side="right")]
