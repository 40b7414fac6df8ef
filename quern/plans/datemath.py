"""Date expressions: now or a date (then ||), and steps +N u, -N u, /u."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from quern.functions.text import MAX_DATE_MS, parse_date

_STEP = re.compile(r"([+\-/])(\d*)([yMwdhHms])")
_MS = {"w": 604_800_000, "d": 86_400_000, "h": 3_600_000, "H": 3_600_000, "m": 60_000, "s": 1000}
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


class BadDate(ValueError):
    pass


def _civil(days: int) -> tuple[int, int, int]:
    """Year, month and day of a day number, for any year."""
    z = days + 719_468
    era, doe = divmod(z, 146_097)
    yoe = (doe - doe // 1460 + doe // 36_524 - doe // 146_096) // 365
    doy = doe - (365 * yoe + yoe // 4 - yoe // 100)
    mp = (5 * doy + 2) // 153
    month = mp + 3 if mp < 10 else mp - 9
    return yoe + era * 400 + (month <= 2), month, doy - (153 * mp + 2) // 5 + 1


def days_from_civil(y: int, m: int, d: int) -> int:
    y -= m <= 2
    era, yoe = divmod(y, 400)
    doy = (153 * (m - 3 if m > 2 else m + 9) + 2) // 5 + d - 1
    return era * 146_097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719_468


def add_months(ms: int, n: int) -> int:
    """The day of the month stays, or becomes the new month's last."""
    day, rest = divmod(ms, _MS["d"])
    y, m, d = _civil(day)
    y, m = divmod(y * 12 + m - 1 + n, 12)
    m += 1
    last = days_from_civil(y + (m == 12), m % 12 + 1, 1) - days_from_civil(y, m, 1)
    return days_from_civil(y, m, min(d, last)) * _MS["d"] + rest


def month_start(ms: int, year: bool = False) -> int:
    y, m, _ = _civil(ms // _MS["d"])
    return days_from_civil(y, 1 if year else m, 1) * _MS["d"]


@dataclass(frozen=True)
class DateMath:
    now: bool
    anchor: int
    fill: int
    steps: tuple[tuple[str, int, str], ...]

    @property
    def fixed_offset(self) -> bool:
        return self.now and all(op != "/" and u not in "yM" for op, _, u in self.steps)

    def resolve(self, now_ms: int, up: bool) -> int:
        ms = now_ms if self.now else self.anchor + (self.fill if up else 0)
        for op, n, u in self.steps:
            if op != "/":
                n = n if op == "+" else -n
                ms = add_months(ms, n * (12 if u == "y" else 1)) if u in "yM" else ms + n * _MS[u]
            else:
                if u in "yM":
                    start = month_start(ms, u == "y")
                    after = add_months(start, 12 if u == "y" else 1)
                elif u == "w":
                    days = ms // _MS["d"]
                    start = (days - (days + 3) % 7) * _MS["d"]
                    after = start + _MS["w"]
                else:
                    start = ms // _MS[u] * _MS[u]
                    after = start + _MS[u]
                ms = after - 1 if up else start
            if abs(ms) > MAX_DATE_MS:
                raise BadDate("outside the dates that a date field holds")
        if abs(ms) > MAX_DATE_MS:
            raise BadDate("outside the dates that a date field holds")
        return ms


def parse(s: str) -> DateMath:
    if s.startswith("now"):
        now, anchor, fill, math = True, 0, 0, s[3:]
    else:
        head, bars, math = s.partition("||")
        got = parse_date(head)
        if not got:
            raise BadDate(f"{s!r} is neither a date nor date math")
        now, (anchor, fill) = False, got
        fill = 0 if bars else fill
    steps, at = [], 0
    while at < len(math):
        m = _STEP.match(math, at)
        if not m or (m[1] == "/" and m[2] not in ("", "1")) or len(m[2]) > 9:
            raise BadDate(f"date math {s!r}: can't read {math[at:]!r}")
        steps.append((m[1], int(m[2] or 1), m[3]))
        at = m.end()
    return DateMath(now, anchor, fill, tuple(steps))


def iso(ms: float) -> str:
    return (_EPOCH + timedelta(milliseconds=ms)).strftime("%Y-%m-%dT%H:%M:%S.") + f"{int(ms) % 1000:03d}Z"
