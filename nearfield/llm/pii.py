"""Format-preserving pseudonyms for personal numbers, dates and addresses.

A value found in a text is checked (card and account check digits, octets, calendar dates, lengths
of phone numbers), read as an integer of its format's value set, and replaced by the image of that integer
under a keyed permutation of the set: a Feistel network over the next even number of bits, walked
along its cycle until the image is a valid value again. Equal values have equal pseudonyms in all
documents, different ones different pseudonyms, and whoever has the key can invert them.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Years of the dates that are permuted among each other.
FIRST, LAST = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()

FORMATS = re.compile(
    r"(?P<email>(?<![\w.%+-])[A-Za-z0-9][\w.%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
    r"|(?P<secret>(?:(?<![A-Za-z0-9])AKIA(?=[A-Z0-9]{16}(?![A-Za-z0-9]))|\b(?i:password|passwd|token|secret|api_?key)\b\s*[=:]\s*[\"']?)(?P<value>[A-Za-z0-9+/_-]{12,}))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d))"
    r"|(?P<iso>(?<![\d/.-])\d{4}[-/]\d{2}[-/]\d{2}(?![\d/-]|\.\d))"
    r"|(?P<date>(?<![\d/.-])\d{1,2}(?P<sep>[./-])\d{1,2}(?P=sep)\d{4}(?![\d/-]|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])|(?<![\w+])\+\d{9,15}(?!\w))"
    r"|(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))"
)
_WORTH_A_LOOK = re.compile(r"[0-9@=:]")


def permute(value: int, size: int, key: bytes, tweak: str, inverse: bool = False) -> int:
    """Image of ``value`` under the keyed permutation of ``range(size)`` that belongs to ``tweak``."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8

    def mixed(i: int, x: int) -> int:
        data = bytes([i]) + x.to_bytes(width, "big")
        digest = hashlib.blake2b(data, key=key, person=tweak.encode()[:16], digest_size=min(64, width)).digest()
        return int.from_bytes(digest, "big") & mask

    while True:
        left, right = value >> half, value & mask
        if inverse:
            for i in reversed(range(ROUNDS)):
                left, right = right ^ mixed(i, left), left
        else:
            for i in range(ROUNDS):
                left, right = right, left ^ mixed(i, right)
        value = left << half | right
        if value < size:
            return value


def luhn(digits: str) -> int:
    """The check digit that completes ``digits``."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _characters(text: str, move: Callable[[int, int], int]) -> str:
    """Permute letters among letters and digits among digits, as one mixed-radix number."""
    classes = [next((c for c in _CLASSES if x in c), None) for x in text]
    value, size = 0, 1
    for x, c in zip(text, classes, strict=True):
        if c:
            value, size = value * len(c) + c.index(x), size * len(c)
    value = move(value, size)
    out = []
    for x, c in zip(reversed(text), reversed(classes), strict=True):
        if c:
            value, at = divmod(value, len(c))
            x = c[at]
        out.append(x)
    return "".join(reversed(out))


def _card(s: str, move) -> str | None:
    d = re.sub(r"\D", "", s)
    if not 13 <= len(d) <= 19 or luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    body = d[0] + str(move(int(d[1:-1]), 10 ** (len(d) - 2), d[0])).zfill(len(d) - 2)
    return _refill(s, body + str(luhn(body)))


def _phone(s: str, move) -> str | None:
    d = re.sub(r"\D", "", s)
    if not 9 <= len(d) <= 15 or len(set(d)) == 1:
        return None
    n = len(d) - 10 if len(d) > 10 else 0  # the country code stays
    code, body = d[:n], d[n:]
    while True:  # one digit repeated is no number, and no image of one
        body = str(move(int(body), 10 ** len(body))).zfill(len(body))
        if len(set(code + body)) > 1:
            return _refill(s, code + body)


def _ip(s: str, move) -> str | None:
    parts = [int(x) for x in s.split(".")]
    if max(parts) > 255 or any(x != str(int(x)) for x in s.split(".")):
        return None
    v = move(int.from_bytes(bytes(parts), "big"), 1 << 32)
    return ".".join(map(str, v.to_bytes(4, "big")))


def _ssn(s: str, move) -> str | None:
    area, group, serial = map(int, s.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    v = move(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999)
    v, serial = divmod(v, 9999)
    area, group = divmod(v, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _iban(s: str, move) -> str | None:
    flat = s.replace(" ", "")
    number = lambda t: int("".join(str(int(c, 36)) for c in t)) % 97
    if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) != 1:
        return None
    body = _characters(flat[4:], move)
    it = iter(flat[:2] + f"{98 - number(body + flat[:2] + '00'):02d}" + body)
    return "".join(c if c == " " else next(it) for c in s)


def _day(y: int, m: int, d: int) -> int | None:
    try:
        n = dt.date(y, m, d).toordinal()
    except ValueError:
        return None
    return n if FIRST <= n <= LAST else None


def _iso(s: str, move) -> str | None:
    if s[4] != s[7] or (n := _day(int(s[:4]), int(s[5:7]), int(s[8:]))) is None:
        return None
    return dt.date.fromordinal(FIRST + move(n - FIRST, LAST - FIRST + 1)).strftime(f"%Y{s[4]}%m{s[4]}%d")


def _date(s: str, move) -> str | None:
    """Day first with dots; else month first, unless only day first can be meant."""
    sep = re.search(r"\D", s)[0]
    a, b, year = s.split(sep)
    day_first = sep == "." or int(a) > 12
    n = _day(year := int(year), *((int(b), int(a)) if day_first else (int(a), int(b))))
    if n is None:
        return None
    while True:  # a day-first date with a slash stays one that cannot be read month first
        n = FIRST + move(n - FIRST, LAST - FIRST + 1)
        day = dt.date.fromordinal(n)
        if sep == "." or not day_first or day.day > 12:
            break
    x, y = (day.day, day.month) if day_first else (day.month, day.day)
    pad = len(a) == 2 and len(b) == 2
    return f"{x:02d}{sep}{y:02d}{sep}{day.year}" if pad else f"{x}{sep}{y}{sep}{day.year}"


def _email(s: str, move) -> str:
    """All but the top-level domain is permuted, without regard to case, which is put back."""
    name, _, top = s.rpartition(".")
    out = _characters(name.lower(), move)
    return "".join(n.upper() if c.isupper() else n for c, n in zip(name, out, strict=True)) + "." + top


_KINDS = {"card": _card, "phone": _phone, "ip": _ip, "ssn": _ssn, "iban": _iban, "iso": _iso, "date": _date, "email": _email}


class Pseudonyms:
    """Replaces the values in texts; the same value again costs a lookup."""

    def __init__(self, key: bytes):
        def one(kind: str, value: str) -> str | None:
            family = "date" if kind == "iso" else kind
            move = lambda v, size, extra="": permute(v, size, key, f"{family}{extra}{size.bit_length()}")
            return _characters(value, move) if kind == "secret" else _KINDS[kind](value, move)

        self.one = lru_cache(1 << 16)(one)

    def __call__(self, text: str) -> tuple[str, int]:
        if not _WORTH_A_LOOK.search(text):
            return text, 0
        found = 0

        def swap(m: re.Match) -> str:
            nonlocal found
            kind = m.lastgroup if m.lastgroup not in ("value", "sep") else ("secret" if m.lastgroup == "value" else "date")
            whole = m[0]
            value = m["value"] if kind == "secret" else whole
            new = self.one(kind, value)
            if new is None:
                return whole
            found += 1
            return whole[: len(whole) - len(value)] + new

        return FORMATS.sub(swap, text), found


def pseudonyms(text: Column | str, key: bytes) -> Column:
    """Struct ``(text, found)``: the text with pseudonyms and how many values were replaced; null for null."""

    @F.pandas_udf("struct<text string, found int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        swap = Pseudonyms(key)
        out = [(None, None) if t is None else swap(t) for t in texts]
        return pd.DataFrame({"text": [o[0] for o in out], "found": pd.array([o[1] for o in out], "Int32")})

    return run(text)


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; a column ``n_chars`` is brought up to date.

    All rows and other columns stay. Null stays null, empty stays empty, and texts without valid
    values stay as they are.
    """
    out = docs.withColumn("text", pseudonyms("text", key)["text"])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
