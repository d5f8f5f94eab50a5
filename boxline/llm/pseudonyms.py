"""Format-preserving pseudonyms for personal data.

Values are found by pattern and validated (check digits, calendar, ranges). A valid one is read as a number
below the size of its format, and a keyed Feistel network permutes the numbers of that format; the result is
written back in the same layout. Equal values thus get equal pseudonyms in all documents, however their
separators are set, different values get different ones, and who holds the key can go back. What follows a value,
as digits behind a card number or capitals behind an IBAN, is no part of it and is looked through in turn.

Null text stays null; empty text, and text without valid values, stays as it is. Ids, repeated rows and other
columns don't bear on the result. Whole texts are read.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

ROUNDS = 8
KINDS = ["email", "secret", "iban", "ip", "date", "ssn", "card", "phone"]

#: Layouts in which values are written.
PATTERN = re.compile(
    r"""
    (?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-]))
  | (?P<secret>(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\b["']?\s*[=:]\s*["']?)
      [A-Za-z0-9_+/-]{8,})
  | (?P<iban>\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b)
  | (?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d))
  | (?P<date>(?<![\d./-])(?:\d{4}(?:-\d{2}-|/\d{2}/|\.\d{2}\.)\d{2}
      |\d{1,2}(?:-\d{1,2}-|/\d{1,2}/|\.\d{1,2}\.)\d{4})(?![\d/-]|\.\d))
  | (?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))
  | (?P<card>(?<![\d.+-])\d(?:[ -]?\d){12,18}(?![\d-]))
  | (?P<phone>(?<![\w.])\+\d{1,3}(?:[ .-]?\(0\))?[ .-]?\(?\d{1,4}\)?(?:[ .-]\d{2,4}){1,4}(?!\w)
      |(?<![\w.])\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?!\w)
      |(?<![\w.+-])(?:\d{3}-\d{3}-\d{4}|\d{3}[.]\d{3}[.]\d{4}|\d{3}[ ]\d{3}[ ]\d{4})(?![\w-])
      |(?<![\w.])\+\d{7,15}(?!\w))
    """,
    re.VERBOSE,
)
#: IBAN lengths of countries, and the calling codes of one and two digits; all others have three.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
CALLING_CODES = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 "
    "81 82 84 86 90 91 92 93 94 95 98"
).split()
_IBAN_LENGTH = {country: n for n, names in IBAN_LENGTHS.items() for country in names.split()}
_CODES = frozenset(CALLING_CODES)
# Every value holds one of these.
HINT = re.compile(r"[0-9@=:]")
_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY


class Permutation:
    """Keyed permutations of the numbers below any size."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _mask(self, label: bytes, number: int, half: int) -> int:
        data = label + bytes([number]) + half.to_bytes((half.bit_length() + 7) // 8 or 1, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big")

    def _once(self, value: int, side: int, label: bytes, back: bool) -> int:
        left, right = divmod(value, side)
        for number in range(ROUNDS)[:: -1 if back else 1]:
            if back:
                left, right = (right - self._mask(label, number, left)) % side, left
            else:
                left, right = right, (left + self._mask(label, number, right)) % side
        return left * side + right

    def apply(
        self, value: int, size: int, label: str, back: bool = False,
        allowed: Callable[[int], bool] | None = None,
    ) -> int:
        """The partner of ``value`` among the allowed numbers below ``size``."""
        side, label = math.isqrt(max(0, size - 1)) + 1, f"{label}/{size}".encode()
        # A permutation of more numbers, followed until it is back among those wanted, permutes them.
        while True:
            value = self._once(value, side, label, back)
            if value < size and (allowed is None or allowed(value)):
                return value


def _lay(template: str, characters: str, which: Callable[[str], bool]) -> str:
    """``template`` with the characters that ``which`` picks replaced in turn."""
    fresh = iter(characters)
    return "".join(next(fresh) if which(c) else c for c in template)


def _first(text: str, count: int, which: Callable[[str], bool], within: bool = False) -> str:
    """The start of ``text`` with ``count`` characters that ``which`` picks, if none follows at once; else "".

    With ``within`` others may follow.
    """
    for i, c in enumerate(text):
        count -= which(c)
        if not count:
            return "" if not within and which(text[i + 1:i + 2]) else text[:i + 1]
    return ""


def _radix(c: str) -> tuple[int, str]:
    if c.isdigit():
        return 10, "0"
    return 26, "A" if c.isupper() else "a"


def _mixed(text: str, permute) -> str:
    """ASCII letters and digits permuted together, each within its own class."""
    signs = [c for c in text if c.isalnum()]
    value, size = 0, 1
    for c in signs:
        radix, zero = _radix(c)
        value, size = value * radix + ord(c) - ord(zero), size * radix
    value, out = permute(value, size), []
    for c in reversed(signs):
        radix, zero = _radix(c)
        value, digit = divmod(value, radix)
        out.append(chr(ord(zero) + digit))
    return _lay(text, "".join(reversed(out)), str.isalnum)


def luhn(digits: str) -> int:
    """The check sum of a digit string; 0 if it is valid."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10


def _iban_rest(text: str) -> int:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


class Pseudonyms:
    """Replaces the valid values of a text; ``back`` restores them."""

    def __init__(self, key: bytes, back: bool = False):
        self.permutation, self.back, self.memory = Permutation(key), back, {}

    def _permute(self, kind: str, allowed=None):
        return lambda value, size: self.permutation.apply(value, size, kind, self.back, allowed)

    def email(self, text: str) -> str:
        name, _, host = text.partition("@")
        return _mixed(name, self._permute("email")) + "@" + host

    def secret(self, text: str) -> str:
        at = re.search(r"[A-Za-z0-9_+/-]+$", text).start()
        return text[:at] + _mixed(text[at:], self._permute("secret"))

    def iban(self, text: str) -> str | None:
        text = _first(text, _IBAN_LENGTH.get(text[:2], 0), str.isalnum)
        plain = text.replace(" ", "")
        if not plain or _iban_rest(plain) != 1:
            return None
        body = _mixed(plain[4:], self._permute("iban" + plain[:2]))
        check = 98 - _iban_rest(plain[:2] + "00" + body)
        return _lay(text, f"{plain[:2]}{check:02d}{body}", lambda c: c != " ")

    def ip(self, text: str) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        value = int.from_bytes(bytes(map(int, parts)), "big")
        value = self._permute("ip")(value, 1 << 32)
        return ".".join(map(str, value.to_bytes(4, "big")))

    def date(self, text: str) -> str | None:
        a, b, c = re.split(r"[-/.]", text)
        orders = ["ymd"] if len(a) == 4 else ["dmy", "mdy"]
        for order in orders:
            named = dict(zip(order, (a, b, c)))
            try:
                day = datetime.date(*(int(named[k]) for k in "ymd")).toordinal() - _FIRST_DAY
            except ValueError:
                continue
            if not 0 <= day < _DAYS:
                return None
            # A date that can only be month first stays one.
            allowed = None
            if order == "mdy":
                allowed = lambda n: datetime.date.fromordinal(n + _FIRST_DAY).day > 12
            # Equal dates share a pseudonym in all layouts but those that must stay month first.
            label = "date-mdy" if allowed else "date"
            new = datetime.date.fromordinal(
                self._permute(label, allowed)(day, _DAYS) + _FIRST_DAY
            )
            two = len(a) == 4 or len(a) == len(b) == 2
            value = {"y": f"{new.year:04d}", "m": f"{new.month:02d}" if two else str(new.month),
                     "d": f"{new.day:02d}" if two else str(new.day)}
            signs = re.findall(r"[-/.]", text)
            return value[order[0]] + signs[0] + value[order[1]] + signs[1] + value[order[2]]
        return None

    def ssn(self, text: str) -> str | None:
        def allowed(value: int) -> bool:
            area, group, serial = value // 10**6, value // 10**4 % 100, value % 10**4
            return area not in (0, 666) and area < 900 and group > 0 and serial > 0

        value = int(text.replace("-", ""))
        if not allowed(value):
            return None
        return _lay(text, f"{self._permute('ssn', allowed)(value, 10**9):09d}", str.isdigit)

    def card(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        # The number may end at any separator; the shortest valid start is it.
        ends = [n for n in range(13, len(digits) + 1) if _first(text, n, str.isdigit)]

        def valid(start: str) -> bool:
            return not luhn(start) and int(start) > 0

        size = next((n for n in ends if valid(digits[:n])), None)
        if size is None:
            return None
        shorter = [n for n in ends if n < size]

        def whole(body: int) -> str:
            # The first digit tells the kind of card and stays, the last is the check digit.
            start = f"{digits[0]}{body:0{size - 2}d}"
            return start + str(-luhn(start + "0") % 10)

        def allowed(body: int) -> bool:
            return not any(valid(whole(body)[:n]) for n in shorter)

        permute = self._permute("card" + digits[0], allowed if shorter else None)
        new = whole(permute(int(digits[1:size - 1]), 10 ** (size - 2)))
        return _lay(_first(text, size, str.isdigit), new, str.isdigit)

    def phone(self, text: str) -> str | None:
        digits, at, code = re.sub(r"\D", "", text), 0, ""
        if text[0] == "+":
            code = next((digits[:n] for n in (1, 2) if digits[:n] in _CODES), digits[:3])
            at = len(_first(text, len(code), str.isdigit, True))
            trunk = re.match(r"[ .-]?\(0\)", text[at:])
            at += trunk.end() if trunk else 0
        rest = re.sub(r"\D", "", text[at:])
        ends = [n for n in range(6, min(14, len(rest)) + 1) if _first(text[at:], n, str.isdigit)]
        # Numbers of this code have ten digits; others are as long as can be.
        size = 10 if code == "1" and 10 in ends else max(ends, default=0)
        if not size:
            return None
        # The number is the same with and without separators, so only its digits bear on its pseudonym.
        new = f"{self._permute('phone')(int(rest[:size]), 10 ** size):0{size}d}"
        return text[:at] + _lay(_first(text[at:], size, str.isdigit), new, str.isdigit)

    def replace(self, text: str, counts: dict[str, int]) -> str:
        """``text`` with pseudonyms; ``counts`` gets the values of each kind."""
        if not HINT.search(text):
            return text

        out, done, at = [], 0, 0
        while match := PATTERN.search(text, at):
            kind, value = match.lastgroup, match.group()
            known = self.memory.get((kind, value), self)
            if known is self:
                known = getattr(self, kind)(value)
                if len(self.memory) < 100_000:
                    self.memory[kind, value] = known
            at = match.end()
            if known is None:
                continue
            if kind in ("iban", "card", "phone"):
                # The layout stays, so the value is as long as its pseudonym.
                at = match.start() + len(known)
            out += [text[done:match.start()], known]
            done = at
            counts[kind] += 1
        return "".join([*out, text[done:]])


def pseudonymise(
    docs: DataFrame, key: bytes, text: str = "text", back: bool = False, prefix: str = "n_"
) -> DataFrame:
    """``docs`` with ``text`` replaced, and the number of values of each of ``KINDS``.

    Columns with the names of the counts are replaced. ``back`` restores original values.
    """
    added = [prefix + k for k in KINDS]
    carried = [c for c in docs.columns if c not in added]
    at = carried.index(text)
    types = {c: docs.schema[c] for c in carried} | {text: StructField(text, StringType())}
    schema = StructType([
        *(types[c] for c in carried), *(StructField(n, IntegerType()) for n in added)
    ])

    def apply(batches):
        worker = Pseudonyms(key, back)
        for batch in batches:
            texts, rows = [], []
            for value in batch.column(at):
                counts = dict.fromkeys(KINDS, 0)
                value = value.as_py()
                texts.append(value if value is None else worker.replace(value, counts))
                rows.append(list(counts.values()))
            columns = batch.columns
            columns[at] = pa.array(texts, pa.string())
            found = list(zip(*rows)) or [()] * len(KINDS)
            yield pa.RecordBatch.from_arrays(
                [*columns, *(pa.array(c, pa.int32()) for c in found)], [*carried, *added]
            )

    return docs.select(*carried).withColumn(text, F.col(text).cast("string")).mapInArrow(apply, schema)
