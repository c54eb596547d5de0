"""Format-preserving pseudonyms of personal numbers and dates.

Payment card numbers that pass the check digit, dates of 1900 to 2099 that exist and are written in figures,
IPv4 addresses, telephone numbers (with country code, and national ones of the United States, France, Germany
and Spain), social security numbers and mail addresses are replaced within their format by a keyed Feistel
permutation, so equal values stay equal in every document and different ones stay different.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import hmac
import os
import re
import string
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lorekeep.llm.store import prepare

ROUNDS = 8
LAST_DAY = datetime.date(2099, 12, 31).toordinal()
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
KNOWN = 100_000
#: The part of a mail address before the @, in Latin, Greek and Cyrillic letters with their marks, and its domain.
LETTER = r"A-Za-z0-9\u00b5\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0370-\u0373\u0376-\u037d\u0386-\u052f\u1e00-\u1fff"
LOCAL = re.compile(rf"[{LETTER}][{LETTER}\u0300-\u036f_.+-]*\Z")
DOMAIN = re.compile(rf"[{LETTER}-]+(?:\.[{LETTER}-]+){{1,6}}")
#: A time or nothing may follow a date.
_AFTER = r"(?![\w-])(?!\.\d)(?!/\d)|(?=[T_]\d\d:?\d\d)"
VALUE = re.compile(
    rf"(?P<date>(?<![\w-])(?<!\d[./])(?:\d{{4}}([-/.])\d\d?\2\d\d?|\d\d?([-/.])\d\d?\3\d{{4}})(?:{_AFTER}))"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<!\w)\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-]))"
    r"|(?P<abroad>(?<!\w)\+\d(?:[ ./-]?\(?\d\)?){6,15}(?!\w)(?!\.\d))",
    re.ASCII,
)
#: Dates and telephone numbers that might be parts of a card: they are looked for between the cards.
PLAIN = re.compile(
    rf"(?P<date>(?<![\w.,-])(?:19|20)\d{{6}}(?![\w-])(?![.,]\d)|(?<![\w.,-])(?:19|20)\d{{6}}(?=T\d{{4}}))"
    r"|(?P<abroad>(?<![\w-])00[1-9]\d{0,2}[ ./-]\(?\d\)?(?:[ ./-]?\(?\d\)?){4,13}(?!\w)(?!\.\d))"
    r"|(?P<phone>(?<![\w.,-])0[1-9](?:[ .-]?\d\d){4}(?![\w-])"  # French
    r"|(?<![\w.,-])[6-9]\d\d(?:([ .-])\d{3}\4\d{3}|([ .-])\d\d\5\d\d\5\d\d)(?![\w-])|(?<![\w.,-])[89]\d([ .-])\d{3}\6\d\d\6\d\d(?![\w-]))"  # Spanish
    r"|(?P<trunk>(?<![\w.,-])(?:\(0[1-9]\d{1,4}\) ?|0[1-9]\d{1,4}(?: ?[/-] ?| ))\d{2,8}(?:[ -]?\d{1,5}){0,3}(?!\w))",  # German
    re.ASCII,
)
#: Digits of a whole number, country code included, where a country has one length.
LENGTHS = {"1": 11, "33": 11, "34": 11, "7": 11, "351": 12, "41": 11, "31": 11, "45": 10, "47": 10, "48": 11}
#: Digits with single separators, in which cards are looked for, and the groups between the separators.
RUN = re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,}(?!\w)", re.ASCII)
#: The shortest values but mail addresses have so many digits near each other.
DIGITS = re.compile(r"\d\W{0,4}\d\W{0,4}\d\W{0,4}\d", re.ASCII)
GROUP = re.compile(r"\d+", re.ASCII)
#: Beginnings and lengths of common cards. They only decide between overlapping numbers that all pass the check digit.
ISSUED = re.compile(r"4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]\d\d|222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)\d{12}|3[47]\d{13}|3(?:0[0-5]|[689]\d)\d{11}|(?:35|6\d)\d{14}(?:\d{3})?", re.ASCII)


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 to size - 1: a balanced Feistel network over the next even number of bits, walked until the result is in range."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for k in range(ROUNDS):
            digest = hmac.digest(key, f"{tweak}|{size}|{k}|{right}".encode(), hashlib.sha256)
            left, right = right, left ^ (int.from_bytes(digest[:16], "big") & mask)
        value = left << half | right
        if value < size:
            return value


def check_digit(digits: str) -> str:
    """The Luhn digit that follows `digits`."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 - k % 2)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


def _refill(pattern: str, digits: str) -> str:
    """`pattern` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


@functools.cache
def _alphabet(c: str) -> str:
    """The letters that may stand for `c`: digits for digits, others of its case in its block of 256."""
    if c.isascii():
        return string.digits if c.isdigit() else string.ascii_lowercase if c.islower() else string.ascii_uppercase
    block, kind = ord(c) >> 8 << 8, unicodedata.category(c)
    return "".join(x for x in map(chr, range(block, block + 256)) if not x.isascii() and unicodedata.category(x) == kind)


def _mail(text: str, key: bytes) -> str:
    local, _, domain = text.partition("@")
    symbols = [c for c in local if c.isalnum()]
    size, n = 1, 0
    for c in symbols:  # letters stay letters in their case, digits stay digits
        letters = _alphabet(c)
        n, size = n * len(letters) + letters.index(c), size * len(letters)
    n, out = permute(n, size, key, f"mail|{domain.lower()}"), []
    for c in reversed(symbols):
        n, d = divmod(n, len(_alphabet(c)))
        out.append(_alphabet(c)[d])
    new = iter(reversed(out))
    return "".join(next(new) if c.isalnum() else c for c in local) + "@" + domain


def mails(text: str) -> list[tuple[int, int]]:
    """Places of mail addresses, by their @."""
    found, at, done = [], text.find("@"), 0
    while at >= 0:
        low = max(done, at - 64)
        if (local := LOCAL.search(text[low:at])) and (domain := DOMAIN.match(text, at + 1)):
            done = domain.end()
            found.append((low + local.start(), done))
        at = text.find("@", max(at + 1, done))
    return found


def _date(text: str, key: bytes) -> str | None:
    """Another date of the same format, whose day and month have as many digits, or None.

    Years come first or last; of the others the day does, unless only month before day gives a date.
    """
    if text.isdigit():
        parts, marks = [text[:4], text[4:6], text[6:]], ["", ""]
    else:
        parts, marks = re.split(r"\D", text), re.findall(r"\D", text)
    orders = ["ymd"] if len(parts[0]) == 4 else ["dmy", "mdy"]
    for order in orders:
        y, m, d = (parts[order.index(c)] for c in "ymd")
        try:
            day = datetime.date(int(y), int(m), int(d)).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        while True:  # until the date can be written in this format
            day = FIRST_DAY + permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date")
            new = datetime.date.fromordinal(day)
            if (len(m) == 2 or new.month < 10) and (len(d) == 2 or new.day < 10) and (order != "mdy" or new.day > 12):
                break
        values = {"y": f"{new.year:04d}", "m": f"{new.month:0{len(m)}d}", "d": f"{new.day:0{len(d)}d}"}
        return "".join(values[c] + mark for c, mark in zip(order, [*marks, ""]))
    return None


def _ip(text: str, key: bytes) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255:
        return None
    n = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, n.to_bytes(4, "big")))


def _ssn(text: str, key: bytes) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas = [a for a in range(1, 900) if a != 666]
    n = permute((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999, key, "ssn")
    n, serial = divmod(n, 9999)
    area, group = divmod(n, 99)
    return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(text: str, key: bytes) -> str:
    digits = _digits(text)
    head, tail = digits[:-7], digits[-7:]
    return _refill(text, head + f"{permute(int(tail), 10**7, key, 'phone|' + head):07d}")


def _trunk(text: str, key: bytes) -> str | None:
    return _phone(text, key) if 8 <= len(_digits(text)) <= 12 else None


def _abroad(text: str, key: bytes) -> str | None:
    """The beginning of `text` that is a number with country code, replaced. Where lengths vary, all but three digits are."""
    skip = 0 if text[0] == "+" else 2
    ends = [m.end() + (text[m.end() : m.end() + 1] == ")") for m in GROUP.finditer(text)]
    sizes = [len(_digits(text[skip:end])) - ("(0)" in text[:end]) for end in ends]
    want = next((n for code, n in LENGTHS.items() if _digits(text[skip:]).startswith(code)), None)
    fits = [e for e, n in zip(ends, sizes) if n == want] or [e for e, n in zip(ends, sizes) if 8 <= n <= 15]
    if not fits:
        return None
    text = text[: fits[-1]]
    if fits[-1] in [e for e, n in zip(ends, sizes) if n == want]:
        return _phone(text, key)
    digits = _digits(text)
    head, tail = digits[: skip + 3], digits[skip + 3 :]
    return _refill(text, head + f"{permute(int(tail), 10 ** len(tail), key, 'phone|' + head):0{len(tail)}d}")


def _is_card(digits: str) -> bool:
    return check_digit(digits[:-1]) == digits[-1] and len(set(digits)) > 1


def _card(text: str, key: bytes) -> str | None:
    digits = _digits(text)
    body = digits[:-1]
    if not _is_card(digits):
        return None
    new = f"{permute(int(body[1:]), 10 ** (len(body) - 1), key, 'card|' + body[0]):0{len(body) - 1}d}"
    return _refill(text, body[0] + new + check_digit(body[0] + new))


def cards(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Places of the cards in a run of digits with single separators.

    The run itself if it passes the check digit, else parts of 13 to 19 digits that pass it and begin and end at
    separators: of those that overlap, the ones that make most digits of common cards, then most digits.
    """
    if len(whole := _digits(text[start:end])) <= 19 and _is_card(whole):
        return [(start, end)]
    groups = [m.span() for m in GROUP.finditer(text, start, end)]
    best: list[tuple[tuple[int, int], int | None]] = [((0, 0), None)]  # up to each group: digits won, and where the card that ends there begins
    for j, (_, last) in enumerate(groups):
        most, digits = (best[j][0], None), ""
        for i in range(j, -1, -1):
            digits = text[slice(*groups[i])] + digits
            if len(digits) > 19:
                break
            if len(digits) >= 13 and _is_card(digits):
                won = best[i][0]
                won = (won[0] + (len(digits) if ISSUED.fullmatch(digits) else 0), won[1] + len(digits))
                if won > most[0]:
                    most = won, i
        best.append(most)
    found, j = [], len(groups)
    while j:
        i = best[j][1]
        if i is not None:
            found.append((groups[i][0], groups[j - 1][1]))
        j = j - 1 if i is None else i
    return found[::-1]


KINDS: dict[str, Callable[[str, bytes], str | None]] = {"mail": _mail, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "trunk": _trunk, "abroad": _abroad, "card": _card}


class Pseudonyms:
    """Replaces values in texts; remembers a bounded number of them."""

    def __init__(self, key: bytes):
        self.key, self.known = key, {}

    def _value(self, kind: str, text: str) -> str | None:
        if (kind, text) not in self.known:
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[kind, text] = KINDS[kind](text, self.key)
        return self.known[kind, text]

    def _places(self, text: str) -> list[tuple[int, int, str]]:
        """Where valid values are, and what replaces them, in order."""
        found = [(a, b, self._value("mail", text[a:b])) for a, b in mails(text)]
        if not DIGITS.search(text):
            return found
        for pattern in (VALUE, RUN, PLAIN):
            for low, high in _gaps(found, len(text)):
                while m := pattern.search(text, low, high):
                    low = m.end()
                    if pattern is RUN:
                        found += [(a, b, self._value("card", text[a:b])) for a, b in cards(text, *m.span())]
                    elif (new := self._value(m.lastgroup, m[0])) is None:  # values that are not valid are left as they are
                        low = m.start() + 1
                    else:
                        low = m.end() if m.lastgroup == "ip" else m.start() + len(new)  # only addresses change their length
                        found.append((m.start(), low, new))
            found.sort()
        return found

    def __call__(self, text: str | None) -> tuple[str | None, int]:
        if not text:
            return text, 0
        found, parts, at = self._places(text), [], 0
        for a, b, new in found:
            parts += [text[at:a], new]
            at = b
        return "".join([*parts, text[at:]]), len(found)


def _gaps(found: list[tuple[int, int, str]], size: int) -> list[tuple[int, int]]:
    """The places between those found."""
    at, gaps = 0, []
    for a, b, _ in found:
        gaps.append((at, a))
        at = b
    return [*gaps, (at, size)]


def pseudonymise(docs: DataFrame, key: bytes | None = None, column: str = "text") -> DataFrame:
    """The rows of docs with values in `column` replaced, and `n_values` replaced in each.

    The key is LOREKEEP_PII_KEY of the driver's environment unless given; there is no default, as whoever has the
    key can invert every pseudonym. Null and empty texts stay, all other columns too, but an `n_values` of docs
    gives way to this one; equal rows get equal results. Very long texts are read whole. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    key = key or os.environ.get("LOREKEEP_PII_KEY", "").encode()
    if not key:
        raise ValueError("a key is needed: pass one or set LOREKEEP_PII_KEY")
    rest = [c for c in docs.columns if c != "n_values"]
    schema = docs.select(rest).schema.add("n_values", "long")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swap = Pseudonyms(key)
        for batch in batches:
            k = batch.schema.get_field_index(column)
            done = [swap(x.as_py()) for x in batch.column(k)]
            columns = list(batch.columns)
            columns[k] = pa.array([t for t, _ in done], batch.schema.field(k).type)
            yield pa.record_batch([*columns, pa.array([n for _, n in done], pa.int64())], names=[*batch.schema.names, "n_values"])

    return docs.select(rest).mapInArrow(replace, schema)
