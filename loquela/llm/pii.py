"""Format-preserving pseudonyms for personal numbers, dates, addresses and keys.

Values are found by pattern, validated (check digits, calendar, ranges) and put through a keyed
Feistel permutation of their own format's domain, so a pseudonym is again a valid value of the
format, equal values stay equal in every document, and whoever has the key can turn them back.
The domain follows from the value and not from its spelling: a telephone number, card, date or
address gets one pseudonym however it is spaced, punctuated or cased. Values that fail
validation are left alone.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loquela.llm._shared import in_slices, task

ROUNDS = 10
FIRST_DAY, DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_PATTERN = re.compile(
    r"""
      (?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![A-Za-z0-9-]))
    | (?P<vendor>(?<![0-9A-Za-z_-])(?:AKIA|ASIA|gh[opsur]_|[sr]k_(?:live|test)_|sk-(?:proj-|ant-)?|xox[abprs]-|AIza|glpat-|npm_)[0-9A-Za-z_-]{16,}(?![0-9A-Za-z_-]))
    | (?P<token>(?<![0-9A-Za-z_.-])eyJ[0-9A-Za-z_-]{5,}\.[0-9A-Za-z_-]{5,}\.[0-9A-Za-z_-]{5,}(?![0-9A-Za-z_-]))
    | (?P<secret>(?<![0-9A-Za-z])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}|[0-9A-F]{64}|[0-9A-F]{40}|[0-9A-F]{32})(?![0-9A-Za-z]))
    | (?P<iban>(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\ ?[0-9A-Z]{4}){2,7}(?:\ ?[0-9A-Z]{1,3})?(?![0-9A-Za-z]))
    | (?P<ip6>(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\w))
    | (?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d))
    | (?P<iso>(?<![\d/.-])\d{4}(?P<m1>[-/.])\d{2}(?P=m1)\d{2}(?![\d]|[-/.]\d))
    | (?P<dmy>(?<![\d/.-])\d{1,2}(?P<m2>[-/.])\d{1,2}(?P=m2)\d{4}(?![\d]|[-/.]\d))
    | (?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))
    | (?P<phone>(?<![\w+])\+(?:1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|[2-9]\d{0,2}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4})(?!\d|\.\d))
    | (?P<local>(?<![\w(])\(\d{3}\)[ .-]?\d{3}[.-]\d{4}(?!\d)|(?<![\d.-])\d{3}(?P<m3>[.-])\d{3}(?P=m3)\d{4}(?![\d-]))
    | (?P<card>(?<![\d.-])(?:\d{13,19}|\d{4}(?P<m4>[ -])\d{4}(?P=m4)\d{4}(?P=m4)\d{1,7}|\d{4}(?P<m5>[ -])\d{6}(?P=m5)\d{5})(?!\d|[.-]\d))
    """,
    re.VERBOSE,
)
_ANY, _WORD = re.compile(r"[0-9@]|AKIA|ASIA|gh[opsur]_|[sr]k_|sk-|xox|AIza|eyJ|glpat|npm_"), re.compile(r"[0-9A-Za-z]+")
# Calling codes of one and two digits; all others have three.
_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


class Permuter:
    """Keyed permutations of integer ranges, one for each kind of value."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, kind: str, n: int, i: int, half: int) -> int:
        data = f"{kind}|{n}|{i}|{half}".encode()
        size = (n.bit_length() + 15) // 16 + 1  # bytes that cover half of the range's bits
        if size <= 64:
            return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=64).digest(), "big")
        return int.from_bytes(hashlib.shake_256(self.key + data).digest(size), "big")

    def permute(self, kind: str, n: int, x: int, back: bool = False) -> int:
        """Of 0 <= x < n, the image (or, back, the origin): a Feistel network on the next even
        number of bits, walked until it falls inside the range again."""
        if n < 2:
            return x
        bits = ((n - 1).bit_length() + 1) // 2
        mask = (1 << bits) - 1
        while True:
            a, b = x >> bits, x & mask
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    a, b = b ^ (self._round(kind, n, i, a) & mask), a
                else:
                    a, b = b, a ^ (self._round(kind, n, i, b) & mask)
            x = a << bits | b
            if x < n:
                return x

    def letters(self, kind: str, text: str, back: bool = False) -> str:
        """Permute the digits and ASCII letters of a text within their classes; the rest stays."""
        classes = [next((c for c in (_DIGITS, _LOWER, _UPPER) if ch in c), "") for ch in text]
        shape = "".join(c[:1] or "-" for c in classes)
        n, x = 1, 0
        for ch, c in zip(text, classes, strict=True):
            if c:
                n, x = n * len(c), x * len(c) + c.index(ch)
        x, out = self.permute(f"{kind}:{shape}", n, x, back), []
        for ch, c in zip(reversed(text), reversed(classes), strict=True):
            if c:
                x, r = divmod(x, len(c))
                ch = c[r]
            out.append(ch)
        return "".join(reversed(out))


def luhn_digit(body: str) -> str:
    """The check digit that completes `body`."""
    total = 0
    for i, ch in enumerate(reversed(body)):
        d = int(ch) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _refill(shape: str, digits: str) -> str:
    """`shape` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _card(p: Permuter, text: str, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    n = len(digits) - 2
    body = digits[0] + str(p.permute(f"card{digits[0]}", 10**n, int(digits[1:-1]), back)).zfill(n)
    return _refill(text, body + luhn_digit(body))


def _iban_check(country: str, body: str) -> str:
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _iban(p: Permuter, text: str, back: bool) -> str | None:
    bare = text.replace(" ", "")
    country, check, body = bare[:2], bare[2:4], bare[4:]
    if not 15 <= len(bare) <= 34 or _iban_check(country, body) != check:
        return None
    body = p.letters(f"iban{country}", body, back)
    it = iter(country + _iban_check(country, body) + body)
    return "".join(c if c == " " else next(it) for c in text)


def _ip(p: Permuter, text: str, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    bases = [(0, 10), (10, 90), (100, 156)]  # numbers of one, two and three digits
    shape, n, x = "", 1, 0
    for part in parts:
        first, count = bases[len(part) - 1]
        shape, n, x = shape + str(len(part)), n * count, x * count + int(part) - first
    x, out = p.permute(f"ip{shape}", n, x, back), []
    for part in reversed(parts):
        first, count = bases[len(part) - 1]
        x, r = divmod(x, count)
        out.append(str(first + r))
    return ".".join(reversed(out))


def _moved(p: Permuter, day: date, back: bool) -> date | None:
    at = (day - FIRST_DAY).days
    return FIRST_DAY + timedelta(p.permute("date", DAYS, at, back)) if 0 <= at < DAYS else None


def _day(y: str, m: str, d: str) -> date | None:
    try:
        return date(int(y), int(m), int(d))
    except ValueError:
        return None


def _iso(p: Permuter, text: str, back: bool) -> str | None:
    mark = text[4]
    day = _day(*text.split(mark))
    new = day and _moved(p, day, back)
    return f"{new.year:04d}{mark}{new.month:02d}{mark}{new.day:02d}" if new else None


def _dmy(p: Permuter, text: str, back: bool) -> str | None:
    """Day first; written with month first only where day first is no date."""
    mark = re.search(r"\D", text)[0]
    a, b, y = text.split(mark)
    day, swap = _day(y, b, a), False
    if not day:
        day, swap = _day(y, a, b), True
    new = day and _moved(p, day, back)
    if not new:
        return None
    if swap and new.day <= 12:
        swap = False  # such a pair is read day first
    first, second = (new.month, new.day) if swap else (new.day, new.month)
    width = 2 if len(a) == len(b) == 2 else 1
    return f"{first:0{width}d}{mark}{second:0{width}d}{mark}{new.year}"


def _ssn(p: Permuter, text: str, back: bool) -> str | None:
    area, group, serial = text.split("-")
    if area in ("000", "666") or area >= "900" or group == "00" or serial == "0000":
        return None
    areas = [i for i in range(1, 900) if i != 666]
    n = len(areas) * 99 * 9999
    x = (areas.index(int(area)) * 99 + int(group) - 1) * 9999 + int(serial) - 1
    x, serial_at = divmod(p.permute("ssn", n, x, back), 9999)
    area_at, group_at = divmod(x, 99)
    return f"{areas[area_at]:03d}-{group_at + 1:02d}-{serial_at + 1:04d}"


def _national(p: Permuter, code: str, rest: str, back: bool) -> str:
    """The digits after a calling code; under code 1 area and exchange begin with 2 to 9 if they did."""
    n, x, bases = 1, 0, []
    for i, ch in enumerate(rest):
        first, count = ((2, 8) if ch >= "2" else (0, 2)) if code == "1" and len(rest) == 10 and i in (0, 3) else (0, 10)
        bases.append((first, count))
        n, x = n * count, x * count + int(ch) - first
    x, out = p.permute(f"phone{code}:{[b for b in bases if b != (0, 10)]}", n, x, back), []
    for first, count in reversed(bases):
        x, r = divmod(x, count)
        out.append(str(first + r))
    return "".join(reversed(out))


def _phone(p: Permuter, text: str, back: bool) -> str | None:
    shape = text.replace("(0)", "(\0)")  # the trunk prefix is no part of the number
    digits = re.sub(r"\D", "", shape)
    if not 8 <= len(digits) <= 15 or digits[0] == "0":
        return None
    code = next((digits[:k] for k in (1, 2) if digits[:k] in _CODES), digits[:3])
    return _refill(shape, code + _national(p, code, digits[len(code) :], back)).replace("\0", "0")


def _local(p: Permuter, text: str, back: bool) -> str | None:
    """Ten digits are the number that +1 stands before elsewhere."""
    return _refill(text, _national(p, "1", re.sub(r"\D", "", text), back))


def _email(p: Permuter, text: str, back: bool) -> str | None:
    name, at, host = text.rpartition("@")
    new = p.letters("email", name.lower(), back)
    return "".join(y.upper() if x.isupper() else y for x, y in zip(name, new, strict=True)) + at + host


def _ip6(p: Permuter, text: str, back: bool) -> str | None:
    """Groups keep their number of hexadecimal digits (zero groups stay), so every spelling keeps its form."""
    try:
        value = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    if int(value) < 2 or not any(c.isdigit() for c in text):
        return None
    groups = [int(g, 16) for g in value.exploded.split(":")]
    bases = [(0, 1) if g == 0 else (16 ** (len(f"{g:x}") - 1), 15 * 16 ** (len(f"{g:x}") - 1)) for g in groups]
    n, x = 1, 0
    for g, (first, count) in zip(groups, bases, strict=True):
        n, x = n * count, x * count + g - first
    x, new = p.permute(f"ip6{bases}", n, x, back), []
    for first, count in reversed(bases):
        x, r = divmod(x, count)
        new.append(first + r)
    new.reverse()
    left = text.partition("::")[0].split(":") if "::" in text else text.split(":")
    given, out = text.split(":"), []
    for i, g in enumerate(given):
        at = i if i < len(left) else 8 - (len(given) - i)
        out.append(f"{new[at]:0{len(g)}x}" if g else g)
    found = ":".join(out)
    return found.upper() if text == text.upper() else found


def _vendor(p: Permuter, text: str, back: bool) -> str | None:
    """A service's key: the prefix that names the service stays."""
    head = re.match(r"[A-Za-z]+(?:_(?:live|test)_|-(?:proj-|ant-)?|_)|AKIA|ASIA|AIza", text)[0] if text[:4] not in ("AKIA", "ASIA", "AIza") else text[:4]
    return head + p.letters(f"vendor{head}", text[len(head) :], back)


def _token(p: Permuter, text: str, back: bool) -> str | None:
    """A signed web token: its header stays, payload and signature keep their alphabet."""
    head, _, rest = text.partition(".")
    return f"{head}.{p.letters('token', rest, back)}"


def _secret(p: Permuter, text: str, back: bool) -> str | None:
    if text.isdecimal() or text.isalpha():
        return None
    new = f"{p.permute('secret', 16 ** len(text), int(text, 16), back):0{len(text)}x}"
    return new.upper() if text.upper() == text else new


KINDS: dict[str, Callable[[Permuter, str, bool], str | None]] = {
    "email": _email, "vendor": _vendor, "token": _token, "secret": _secret, "ip6": _ip6, "iban": _iban, "ip": _ip, "iso": _iso, "dmy": _dmy, "ssn": _ssn, "phone": _phone, "local": _local, "card": _card,
}


def pseudonymise(text: str | None, permuter: Permuter, back: bool = False) -> tuple[str | None, list[tuple[int, int, str]]]:
    """(the text with its personal values permuted, (start, end, kind) of each in the input)."""
    if not text or not _ANY.search(text):
        return text, []
    spans, out, done = [], [], 0
    at = 0
    while m := _PATTERN.search(text, at):
        kind = next(k for k in KINDS if m[k] is not None)
        new = KINDS[kind](permuter, m[0], back)
        if new is None:
            # what looked like one kind may hold another behind its first character run
            step = _WORD.match(text, m.start())
            at = step.end() if step else m.start() + 1
            continue
        out += [text[done : m.start()], new]
        spans.append((m.start(), m.end(), kind))
        at = done = m.end()
    return "".join([*out, text[done:]]), spans


def pseudonyms(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with `text_col` pseudonymised and `pii_spans` (start, end, kind) added.

    A map over partitions: no shuffle, no state. Null and empty texts stay as they are, with no
    spans. All other columns stay; where one is named `pii_spans`, the new one gets underscores
    behind its name until it is free. Very long texts are processed whole. A text's length
    doesn't change.
    """
    names, added = list(docs.columns), "pii_spans"
    while added in names:
        added += "_"
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permuter = Permuter(key)
        for batch in in_slices(batches, text_col):
            texts, spans = [], []
            for text in batch.column(text_col).to_pylist():
                new, found = pseudonymise(text, permuter)
                texts.append(new)
                spans.append([{"start": a, "end": b, "kind": k} for a, b, k in found])
            columns = [pa.array(texts, pa.string()) if n == text_col else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, span)], [*names, added])

    rows = docs.select(*[F.col(f"`{n}`").cast("string").alias(n) if n == text_col else F.col(f"`{n}`") for n in names])
    kinds = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes)
    return rows.mapInArrow(task(run), f"{kinds}, {added} array<struct<start:int,end:int,kind:string>>")
