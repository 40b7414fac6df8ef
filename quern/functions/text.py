"""What a value is as text: normal form, words, entries, trigrams. Python's own string rules are the definition."""

from __future__ import annotations

import json
import re
import unicodedata
from datetime import datetime, timezone

import numpy as np

_NON_WORD = re.compile(r"\W+")
_RUN = re.compile(r"[^\W_]+")
_DATE = re.compile(r"\d{4}-\d\d-\d\d\Z")
_TIME = re.compile(r"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)([.,]\d{1,9})?(Z|[+-]\d\d:\d\d)\Z")
MAX_DATE_MS = 8_640_000_000_000_000


def normalize(s: str) -> str:
    return " ".join(s.replace("\x00", "\ufffd").split()).casefold()


def words(s: str) -> str:
    """The words of s, each between single spaces, so that a phrase is a substring; a lone space if there is none."""
    inner = _NON_WORD.sub(" ", normalize(unicodedata.normalize("NFKC", s))).strip()
    return f" {inner} " if inner else " "


def entries(value) -> list[str]:
    """Distinct normal entries in code point order: of a list its texts, of a text what ", " parts."""
    if isinstance(value, str):
        parts = value.split(", ")
    elif isinstance(value, list):
        parts = [t for t in (as_text(v) for v in value) if t is not None]
    else:
        return []
    return sorted({n for n in map(normalize, parts) if n})


class Whole(int):
    """An integer literal, which keeps its spelling."""

    text = ""


class Broken(float):
    """A float literal."""


def _int(s: str):
    x = Whole(int(s)) if len(s) < 4000 else Whole(0)
    x.text = "0" if s == "-0" else s
    return x


def loads(raw: str):
    """JSON with the last of repeated keys, and number literals that remember whether they were whole."""
    return json.loads(raw, parse_int=_int, parse_float=Broken)


def as_text(v) -> str | None:
    if isinstance(v, str):
        return normalize(v)
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, Whole):
        return v.text
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (float, np.floating)):
        return repr(float(v))
    return None


def as_number(v) -> float | None:
    if isinstance(v, (bool, str)) or not isinstance(v, (int, float, np.integer, np.floating)):
        return None
    try:
        x = float(v.text) if isinstance(v, Whole) and v.text else float(v)
    except OverflowError:
        return None
    return x + 0.0 if np.isfinite(x) else None


def parse_date(s: str) -> tuple[int, int] | None:
    """Unix ms of YYYY-MM-DD or RFC 3339 text, and the ms that its form leaves open; None for other text."""
    try:
        if _DATE.match(s):
            at, fill = datetime.strptime(s, "%Y-%m-%d").replace(tzinfo=timezone.utc), 86_399_999
            frac = 0
        elif m := _TIME.match(s):
            at = datetime.fromisoformat(m[1] + ("+00:00" if m[3] == "Z" else m[3]))
            frac, fill = int((m[2] or ".0")[1:].ljust(3, "0")[:3]), 0 if m[2] else 999
        else:
            return None
    except ValueError:
        return None
    delta = at - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86_400 + delta.seconds) * 1000 + frac, fill


def as_date(v) -> float | None:
    if isinstance(v, str):
        got = parse_date(v)
        return float(got[0]) if got else None
    return as_number(v)


def trigrams(s: str) -> frozenset[str]:
    """Three-letter windows of each run of letters and digits, padded by two before and one after."""
    out = set()
    for run in _RUN.findall(s.lower()):
        padded = f"  {run} "
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return frozenset(out)


def similarity(a: frozenset[str], b: frozenset[str]) -> float:
    shared = len(a & b)
    whole = len(a) + len(b) - shared
    return float(np.float32(shared) / np.float32(whole)) if whole else 0.0
