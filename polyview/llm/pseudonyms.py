"""Personal data: format-preserving pseudonyms by a keyed Feistel network.

Found values are validated, permuted within their own format by a keyed bijection, and put back with their
separators, so equal values get equal pseudonyms in all documents and nothing else in a text changes.

kind    what counts as valid                                        what is permuted
card    13 to 19 digits, perhaps in groups, with a right Luhn sum   all but the last digit, which is made right again
phone   +country code and 7 to 14 further digits in groups, or      the digits after the country code
        the form (ddd) ddd-dddd or ddd-ddd-dddd
ssn     ddd-dd-dddd, first group not 000, 666 or 9xx                the nine digits, within the valid numbers
ipv4    four numbers of 0 to 255                                    the four numbers, each within its width
date    a calendar date from 1900 to 2099 as yyyy-mm-dd, yyyy/mm/dd,the day's number within those two centuries, by one map
        dd.mm.yyyy, dd/mm/yyyy or mm/dd/yyyy, also before a time     for all forms; days after the 12th of a month among
        (T10:00). Where both could be, it is dd/mm/yyyy              themselves, so that mm/dd/yyyy reads back as that
email   an address with a dotted domain                             letters and digits of the local part, by kind

Among other numbers, a card is looked for at the borders of the digits' groups: first in the usual groups, then as all
digits together, then as any groups of three digits and more (the last may have fewer). If pseudonyms make other groups
of such a row of numbers right by chance, rewriting back may take those.

The Feistel network alternates over two halves with keyed BLAKE2b as round function and walks its cycle until
the value lies in the format's domain, so each map is a bijection of that domain, and ``rewrite(back=True)`` inverts
it (the same walk backwards). Nulls stay null, empty texts empty; a text without valid values
is returned as it was. Rows are independent; other columns are kept as they are.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyview.llm.common import fresh_worker

KINDS = ("card", "phone", "ssn", "ipv4", "date", "email")
ROUNDS = 8
_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64})@((?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24})(?![A-Za-z0-9-])")
NUMBERS = re.compile(
    r"(?<![\w.@+-])(?:"
    r"(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})"
    r"|(?P<date>\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})"
    r"|(?P<ipv4>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
    r"|(?P<card>\d(?:[ -]?\d){12,18})"
    r")(?:(?(date)(?=[Tt]\d)|(?!))|(?![\w@]|[.-]\d))"
)
#: What may not follow a number, as above.
_GOES_ON = re.compile(r"[\w@]|[.-]\d")
_RUN, _GROUP = re.compile(r"\d(?:[ -]?\d)*"), re.compile(r"\d+")
#: Usual groups of a card's digits, and groups that a card among other numbers has at least.
_USUAL = re.compile(r"(?:1[3-9]|4 4 4 [1-3]|4 4 4 4(?: [1-3])?|4 6 [45]|6 13|8 8)")
_LARGE = re.compile(r"(?:(?:[3-9]|1\d) )+\d+")
#: Any of the above starts with a digit, or with one of these marks before a digit.
HINT = re.compile(r"\d[\d.\-/ ()]{4,}\d")


def luhn(digits: str) -> int:
    """The Luhn sum modulo 10; 0 for a right number."""
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10


class Pseudonyms:
    """Keyed bijections of the formats; ``key`` is secret."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.permuted = lru_cache(100_000)(self._permuted)

    def _round(self, kind: str, size: int, i: int, half: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{kind}|{size}|{i}|{half}".encode(), key=self.key, digest_size=16).digest(), "big")

    def _permuted(self, kind: str, size: int, value: int, back: bool = False) -> int:
        """A permutation of 0 .. size-1 that depends on the key and the kind."""
        side = max(2, int(size**0.5))
        while side * side < size:
            side += 1
        while True:
            left, right = divmod(value, side)
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    left, right = (right - self._round(kind, size, i, left)) % side, left
                else:
                    left, right = right, (left + self._round(kind, size, i, right)) % side
            value = left * side + right
            if value < size:
                return value

    def digits(self, kind: str, text: str, back: bool = False) -> str:
        return str(self.permuted(kind, 10 ** len(text), int(text), back)).zfill(len(text))

    def value(self, kind: str, found: str, back: bool = False) -> str | None:
        """The pseudonym in the same format; None if the value isn't valid."""
        return getattr(self, f"_{kind}")(found, back)

    def _card(self, found: str, back: bool) -> str | None:
        d = re.sub(r"\D", "", found)
        if luhn(d) or len(set(d)) == 1:
            return None
        head = self.digits("card", d[:-1], back)
        return _fill(found, head + str((10 - luhn(head + "0")) % 10))

    def _phone(self, found: str, back: bool) -> str | None:
        code = re.match(r"\+\d{1,3}(?=[ .(-])", found)
        kept = len(code[0]) if code else 1 if found[0] == "+" else 0
        d = re.sub(r"\D", "", found[kept:])
        if not 7 <= len(d) <= 14:
            return None
        return found[:kept] + _fill(found[kept:], self.digits("phone", d, back))

    def _ssn(self, found: str, back: bool) -> str | None:
        area, group, serial = map(int, found.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        areas = [a for a in range(1, 900) if a != 666]
        n = self.permuted("ssn", len(areas) * 99 * 9999, ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, back)
        n, serial = divmod(n, 9999)
        area, group = divmod(n, 99)
        return f"{areas[area]:03}-{group + 1:02}-{serial + 1:04}"

    def _ipv4(self, found: str, back: bool) -> str | None:
        parts = [int(x) for x in found.split(".")]
        if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in found.split(".")):
            return None
        # Each number keeps its width, so the text keeps its length.
        least = [(0, 10, 100)[len(str(x)) - 1] for x in parts]
        sizes = [(10, 90, 156)[len(str(x)) - 1] for x in parts]
        value = 0
        for x, lo, n in zip(parts, least, sizes, strict=True):
            value = value * n + x - lo
        value = self.permuted("ipv4|" + ",".join(map(str, sizes)), sizes[0] * sizes[1] * sizes[2] * sizes[3], value, back)
        out = []
        for lo, n in zip(reversed(least), reversed(sizes), strict=True):
            value, x = divmod(value, n)
            out.append(str(lo + x))
        return ".".join(reversed(out))

    def _date(self, found: str, back: bool) -> str | None:
        a, b, c = (int(x) for x in re.split(r"\D", found))
        form = "ymd" if found[4] in "-/" else "dmy" if found[2] == "." or b <= 12 else "mdy"
        y, m, d = {"ymd": (a, b, c), "dmy": (c, b, a), "mdy": (c, a, b)}[form]
        try:
            day = datetime.date(y, m, d).toordinal()
        except ValueError:
            return None
        if not _FIRST <= day <= _LAST:
            return None
        late = d > 12
        days = _days(late)
        new = datetime.date.fromordinal(days[self.permuted(f"date|{late}", len(days), bisect.bisect_left(days, day), back)])
        parts = {"ymd": (f"{new.year:04}", f"{new.month:02}", f"{new.day:02}"), "dmy": (f"{new.day:02}", f"{new.month:02}", f"{new.year:04}"), "mdy": (f"{new.month:02}", f"{new.day:02}", f"{new.year:04}")}[form]
        mark = re.search(r"\D", found)[0]
        return mark.join(parts)

    def _email(self, found: str, back: bool) -> str | None:
        local, _, domain = found.partition("@")
        out, size, value = [], 1, 0
        for c in local:
            base = _base(c)
            if base:
                size, value = size * len(base), value * len(base) + base.index(c)
        if size == 1:
            return None
        value = self.permuted(f"email|{domain.lower()}", size, value, back)
        for c in reversed(local):
            base = _base(c)
            if base:
                value, k = divmod(value, len(base))
                c = base[k]
            out.append(c)
        return "".join(reversed(out)) + "@" + domain

    def rewrite(self, text: str | None, back: bool = False) -> tuple[str | None, dict[str, int]]:
        """The text with pseudonyms, and how many values of each kind were replaced."""
        counts = dict.fromkeys(KINDS, 0)
        if not text:
            return text, counts

        def email(m: re.Match) -> str:
            new = self.value("email", m[0], back)
            counts["email"] += new is not None
            return m[0] if new is None else new

        if "@" in text:
            text = EMAIL.sub(email, text)
        if HINT.search(text):
            text = self._numbers(text, 0, len(text), back, counts)
        return text, counts

    def _numbers(self, text: str, at: int, end: int, back: bool, counts: dict[str, int]) -> str:
        """text[at:end] with the pseudonyms of its numbers."""
        out, tried = [], at  # no card starts before ``tried``
        look = at
        while m := NUMBERS.search(text, look, end):
            a, b, new = m.start(), m.end(), None
            if m.lastgroup != "card":
                new = self.value(m.lastgroup, m[0], back)
            elif a >= tried:
                a, b, new = self._card_in(text, a, b, end, back)
                tried = m.end()
            if new is None:
                # other numbers may start at the next group of what is no card
                look = _GROUP.match(text, m.start()).end() if m.lastgroup == "card" else m.end()
                continue
            counts[m.lastgroup] += 1
            out += [text[at : m.start()], self._numbers(text, m.start(), a, back, counts) if a > m.start() else "", new]
            at = look = b
        return "".join(out) + text[at:end]

    def _card_in(self, text: str, a: int, b: int, end: int, back: bool) -> tuple[int, int, str | None]:
        """Where a card is in text that starts between a and b, and its pseudonym. First come usual groups, then all
        of a to b, then other runs of groups."""
        groups = [g.span() for g in _GROUP.finditer(text, a, min(_RUN.match(text, a, end).end(), b + 40))]
        spans = []
        for i, (x, _) in enumerate(groups):
            if x >= b:
                break
            size, shape = 0, []
            for p, q in groups[i:]:
                size += q - p
                if size > 19:
                    break
                shape.append(str(q - p))
                if size >= 13 and not _GOES_ON.match(text, q, end):
                    form = " ".join(shape)
                    spans.append((0 if _USUAL.fullmatch(form) else 2 if _LARGE.fullmatch(form) else 3, x, -q))
        for rank, x, q in sorted([s for s in spans if s[0] < 3] + [(1, a, -b)]):
            new = self._card(text[x:-q], back)
            if new is not None:
                return x, -q, new
        return a, b, None


@lru_cache(2)
def _days(late: bool) -> list[int]:
    """Numbers of the days after the 12th of their months, or of the others."""
    return [day for day in range(_FIRST, _LAST + 1) if (datetime.date.fromordinal(day).day > 12) == late]


_DIGITS, _LOW, _UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _base(c: str) -> str:
    return _DIGITS if c in _DIGITS else _LOW if c in _LOW else _UP if c in _UP else ""


def _fill(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    d = iter(digits)
    return "".join(next(d) if c.isdigit() else c for c in shape)


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """docs with the text rewritten, and a count ``n_<kind>`` for each of KINDS."""

    @F.pandas_udf("t string, " + ", ".join(f"n_{k} long" for k in KINDS))
    def rewritten(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fresh_worker()
        tool = Pseudonyms(key)
        for b in batches:
            rows = [tool.rewrite(t) for t in b]
            yield pd.DataFrame({"t": [t for t, _ in rows]} | {f"n_{k}": [n[k] for _, n in rows] for k in KINDS})

    names = [c for c in docs.columns if c not in {f"n_{k}" for k in KINDS}]
    out = docs.withColumn("_r", rewritten(F.col(text)))
    return out.select(*[F.col("_r.t").alias(c) if c == text else F.col(c) for c in names], *[f"_r.n_{k}" for k in KINDS])
