"""Format-preserving pseudonyms for personal data.

Values are found by their format and checked (card check digits, IBAN remainders, real calendar dates, octet ranges), then
permuted within the format by a keyed Feistel network, so equal values stay equal in all documents and the pseudonym passes the same
check.  Domains that are no power of the radix are walked in cycles.  A candidate that fails its check is tried again without the groups at its
end (an IBAN first by its country's length), then the search goes on behind its first character; what never passes is left alone.

What is replaced: e-mail addresses (letters and digits of the local part), telephone numbers with a country code or in
``(ddd) ddd-dddd`` form, IPv4 addresses, card numbers of 13 to 19 digits, IBANs, US social security numbers, dates in
``YYYY-MM-DD``, ``YYYY/MM/DD``, ``DD.MM.YYYY``, ``DD/MM/YYYY`` and, where that is no date, ``MM/DD/YYYY`` (permuted among such dates), and values of ``token|secret|password|api_key = "..."``.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import hmac
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlattice.llm.text import chunks

ROUNDS = 10
KINDS = ("secret", "email", "iban", "date", "ipv4", "phone", "ssn", "card")
_PATTERN = re.compile(
    r"(?P<secret>(?i:\b(?:token|secret|password|passwd|api[_-]?key)\s*[=:]\s*[\"'])[A-Za-z0-9+/_\-]{8,}(?=[\"']))"
    r"|(?P<email>(?<![\w.+\-])[\w.+\-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62})\.)+[A-Za-z]{2,24}(?![\w\-]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w))"
    r"|(?P<date>(?<![\w./\-])(?:[0-9]{4}([/\-])[0-9]{2}\5[0-9]{2}|[0-9]{2}([./])[0-9]{2}\6[0-9]{4})(?![\w/\-]|\.[0-9]))"
    r"|(?P<ipv4>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9]))"
    r"|(?P<phone>(?<!\w)\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){2,4}(?!\w)|(?<![\w+])\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}(?!\w))"
    r"|(?P<ssn>(?<![\w\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w\-]))"
    r"|(?P<card>(?<![\w\-])[0-9](?:[ \-]?[0-9]){12,18}(?!\w|-(?![0-9])))",
)
_PHONE = re.compile(r"\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){2,4}")
#: Characters of an IBAN by country.
IBAN_LENGTHS = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in cs.split()}
_MAY = re.compile(r"[0-9@]|(?i:token|secret|passw|api)")
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


@lru_cache(1)
def _month_first() -> list[int]:
    """The days whose ``MM/DD/YYYY`` is no date as ``DD/MM/YYYY``."""
    return [x for x in range(_FIRST_DAY, _LAST_DAY + 1) if datetime.date.fromordinal(x).day > 12]


class Feistel:
    """Keyed permutation of ``range(n)`` for any ``n``: a balanced network on the next even number of bits, walked until it lands inside."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tag: bytes, i: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        said = hmac.new(self.key, b"%b|%d|%d" % (tag, i, half), hashlib.sha256).digest()
        while len(said) < size:
            said += hashlib.sha256(said).digest()
        return int.from_bytes(said[:size], "big") & ((1 << bits) - 1)

    def permute(self, x: int, n: int, tag: str, inverse: bool = False) -> int:
        if not 0 <= x < n:
            raise ValueError("outside the domain")
        if n < 2:
            return x
        bits, name = max(1, ((n - 1).bit_length() + 1) // 2), f"{tag}|{n}".encode()
        mask = (1 << bits) - 1
        while True:
            a, b = x >> bits, x & mask
            for i in range(ROUNDS) if not inverse else reversed(range(ROUNDS)):
                if inverse:
                    a, b = b ^ self._round(name, i, a, bits), a
                else:
                    a, b = b, a ^ self._round(name, i, b, bits)
            x = a << bits | b
            if x < n:
                return x


def luhn_digit(body: str) -> str:
    """The check digit that makes ``body`` plus it valid."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


class Pseudonyms:
    """``of(kind, value)``: the pseudonym, or None where the value fails its check.  ``back`` gives the value again."""

    def __init__(self, key: bytes):
        self.f = Feistel(key)
        self.of = lru_cache(100_000)(lambda kind, value: self._map(kind, value, False))

    def back(self, kind: str, value: str) -> str | None:
        return self._map(kind, value, True)

    def _digits(self, digits: str, tag: str, inverse: bool) -> str:
        return f"{self.f.permute(int(digits), 10 ** len(digits), tag, inverse):0{len(digits)}d}" if digits else ""

    def _letters(self, value: str, tag: str, inverse: bool) -> str:
        """Letters and digits permuted together, each place keeping its class; other characters stay."""
        classes = [("0123456789", c.isdigit()) if c.isdigit() else ("abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ", True) for c in value if c.isascii() and c.isalnum()]
        number, n = 0, 1
        for c, (alphabet, _) in zip((c for c in value if c.isascii() and c.isalnum()), classes, strict=True):
            number, n = number * len(alphabet) + alphabet.index(c), n * len(alphabet)
        number = self.f.permute(number, n, tag, inverse)
        out = []
        for alphabet, _ in reversed(classes):
            number, k = divmod(number, len(alphabet))
            out.append(alphabet[k])
        return "".join(out.pop() if c.isascii() and c.isalnum() else c for c in value)

    @staticmethod
    def _pour(value: str, digits: str) -> str:
        """``digits`` in the places that digits or capitals have in ``value``."""
        it = iter(digits)
        return "".join(next(it) if c.isdigit() or c.isupper() else c for c in value)

    def _us_date(self, value: str, inverse: bool) -> str | None:
        try:
            day = datetime.date(int(value[6:]), int(value[:2]), int(value[3:5])).toordinal()
        except ValueError:
            return None
        if not _FIRST_DAY <= day <= _LAST_DAY:
            return None
        days = _month_first()
        new = datetime.date.fromordinal(days[self.f.permute(bisect.bisect_left(days, day), len(days), "date month first", inverse)])
        return f"{new.month:02d}/{new.day:02d}/{new.year:04d}"

    def _map(self, kind: str, value: str, inverse: bool) -> str | None:
        digits = "".join(c for c in value if c in "0123456789")
        if kind == "card":
            if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
                return None
            body, n = digits[:-1], 10 ** (len(digits) - 1)
            number = int(body)
            while True:  # the one-digit runs aren't cards and are walked over
                number = self.f.permute(number, n, "card", inverse)
                body = f"{number:0{len(digits) - 1}d}"
                if len(set(body + luhn_digit(body))) > 1:
                    return self._pour(value, body + luhn_digit(body))
        if kind == "iban":
            plain = value.replace(" ", "")
            if not 15 <= len(plain) <= 34 or int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 != 1:
                return None
            rest = self._letters(plain[4:], "iban" + plain[:2], inverse)
            return self._pour(value, plain[:2] + iban_check(plain[:2], rest) + rest)
        if kind == "date":
            year_first = value[4] in "/-"
            if value[2] == "/" and int(value[:2]) <= 12 < int(value[3:5]):
                return self._us_date(value, inverse)
            y, m, d = (value[:4], value[5:7], value[8:]) if year_first else (value[6:], value[3:5], value[:2])
            try:
                day = datetime.date(int(y), int(m), int(d)).toordinal()
            except ValueError:
                return None
            if not _FIRST_DAY <= day <= _LAST_DAY:
                return None
            new = datetime.date.fromordinal(_FIRST_DAY + self.f.permute(day - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, "date", inverse))
            y, m, d = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
            return value[4].join((y, m, d)) if year_first else value[2].join((d, m, y))
        if kind == "ipv4":
            parts = value.split(".")
            if any(int(p) > 255 or p != str(int(p)) for p in parts):
                return None
            number = self.f.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ipv4", inverse)
            return ".".join(map(str, number.to_bytes(4, "big")))
        if kind == "phone":
            country = re.match(r"\+\d{1,3}(?=[ .\-(])|\+\d|", value)[0]
            own = value[len(country):]
            count = sum(c.isdigit() for c in value)
            if not 7 <= count <= 15:
                return None
            return country + self._pour(own, self._digits("".join(c for c in own if c.isdigit()), "phone" + country, inverse))
        if kind == "ssn":
            area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
            if area in (0, 666) or area >= 900 or not group or not serial:
                return None
            areas = [a for a in range(1, 900) if a != 666]
            number = self.f.permute((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999, "ssn", inverse)
            rest, serial = divmod(number, 9999)
            area, group = divmod(rest, 99)
            return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"
        if kind == "email":
            local, _, domain = value.rpartition("@")
            if local[0] == "." or local[-1] == "." or ".." in local:
                return None
            return f"{self._letters(local, 'email' + domain.lower(), inverse)}@{domain}"
        cut = max(value.rfind('"'), value.rfind("'")) + 1
        return value[:cut] + self._letters(value[cut:], "secret", inverse)


def _spans(kind: str, found: str) -> Iterator[tuple[int, int]]:
    """The parts of a candidate to be checked, in order: the whole, then what ends before one of its separators, longest first."""
    whole = len(found)
    marks = {"card": " -", "iban": " ", "phone": " "}.get(kind, "")  # a dot or dash behind a telephone number's last blank may be another value's
    ends = [i for i in range(whole - 1, 0, -1) if found[i] in marks]
    if kind == "iban":
        size = IBAN_LENGTHS.get(found[:2])
        exact = [i for i in (whole, *ends) if i - found.count(" ", 0, i) == size]
        yield from ((0, i) for i in exact)
        yield 0, whole
        yield from ((0, i) for i in (() if size else ends))
    elif kind == "email":
        yield 0, whole
        if found[0] == ".":
            yield whole - len(found.lstrip(".")), whole
    else:
        yield 0, whole
        yield from ((0, i) for i in ends if kind != "phone" or _PHONE.fullmatch(found, 0, i))


def replace(text: str, names: Pseudonyms) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many values of each kind were replaced."""
    counts: dict[str, int] = {}
    if not _MAY.search(text):
        return text, counts

    out, done, at = [], 0, 0
    while m := _PATTERN.search(text, at):
        kind = m.lastgroup if m.lastgroup in KINDS else next(k for k in KINDS if m[k] is not None)
        for lo, hi in _spans(kind, m[0]):
            new = names.of(kind, m[0][lo:hi])
            if new is not None:
                counts[kind] = counts.get(kind, 0) + 1
                out += (text[done:m.start() + lo], new)
                done = at = m.start() + hi
                break
        else:
            at = m.start() + 1
    return "".join(out) + text[done:], counts


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", counts: str = "pii") -> DataFrame:
    """Every row with its whole text pseudonymised, and ``counts``: replaced values per kind (a map, empty where none).

    Null and empty texts stay as they are and long ones are worked on whole; other columns are kept, an existing ``counts`` column is replaced (``_pii`` is
    this function's own name); repeated rows give equal results, an empty table stays empty.
    """
    docs = docs.drop(counts)

    def run(series: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = Pseudonyms(key)
        for texts in series:
            out, found = [], []
            for lo, part in chunks(texts):
                for i, t in enumerate(part.to_pylist()):
                    new, n = replace(t, names)
                    out.append(None if not texts[lo + i].is_valid else new)
                    found.append(list(n.items()))
            yield pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(found, pa.map_(pa.string(), pa.int64()))], names=["text", "counts"])

    done = docs.withColumn("_pii", F.arrow_udf(run, "text string, counts map<string,bigint>")(F.col(text)))
    return done.withColumns({text: F.col("_pii.text"), counts: F.col("_pii.counts")}).drop("_pii")
