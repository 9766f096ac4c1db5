"""Format-preserving pseudonyms of personal numbers, dates and addresses.

Values are found by their form and kept only if they are valid: cards by their
Luhn digit, IBANs by their remainder by 97, internet addresses by their octets,
social security numbers by their ranges, dates by the calendar, phone numbers by
their length. Each kind is numbered from 0 to its count of valid values, a keyed
Feistel network permutes the numbers (walking on while a number falls outside),
and the new number is written in the form the old one had. So equal values stay
equal across documents however they are written, different ones stay different,
and check digits hold again. Dates are permuted among those whose day and month
have as many digits each, so that no form of writing them changes its width.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phyllo.llm.arrow import map_batches

#: The session's setting that names the key. It has "secret" in its name, so Spark's pages and logs don't show it.
KEY_SETTING = "spark.phyllo.pii.secret"
#: Only for the registered query, whose tables hold made-up values, where the session names no key.
QUERY_KEY = b"key of the query over made-up values"
ROUNDS = 10
KINDS = ["email", "phone", "card", "ip", "ssn", "iban", "date"]
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
# Alphabets of mail names; letters of other scripts stay as they are.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"]
#: Country codes of two digits; 1 and 7 stand alone, and all others have three.
TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_PLACE = {c: (len(a), i, a) for a in ALPHABETS for i, c in enumerate(a)}

NUMBERS = re.compile(
    r"""(?<![\w@])(?:
      (?P<iso>\d{4}-\d{2}-\d{2})(?![\w-])
    | (?P<day>\d{1,2}(?P<sep>[/.-])\d{1,2}(?P=sep)\d{4})(?![\w])
    | (?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])
    | (?P<phone>\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+[2-9]\d{0,2}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,3}|\(\d{3}\)[ ]?\d{3}[-. ]\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?![\w])
    | (?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?![\w]|\.\d)
    | (?P<card>\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}(?P<gap2>[ -])\d{6}(?P=gap2)\d{5})(?![\w])
    )""",
    re.X,
)
EMAIL = re.compile(r"[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?!\w)")


class Feistel:
    """A keyed permutation of the numbers below any bound."""

    def __init__(self, key: bytes):
        self.key = key if len(key) <= 64 else hashlib.sha512(key).digest()

    def _round(self, tweak: bytes, step: int, value: int, bound: int) -> int:
        data = step.to_bytes(1, "big") + len(tweak).to_bytes(2, "big") + tweak + value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big") % bound

    def __call__(self, value: int, bound: int, tweak: bytes) -> int:
        """Where ``value`` goes among the numbers below ``bound``; ``tweak`` names the permutation."""
        if bound < 2:
            return value
        a = math.isqrt(bound - 1) + 1
        b = -(-bound // a)
        while True:
            left, right = divmod(value, b)  # left below a, right below b
            for step in range(ROUNDS):
                if step % 2:
                    right = (right + self._round(tweak, step, left, b)) % b
                else:
                    left = (left + self._round(tweak, step, right, a)) % a
            value = left * b + right
            if value < bound:
                return value


def luhn_digit(digits: str) -> int:
    """The digit that completes a number by Luhn's rule."""
    doubled = [2 * int(d) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits))]
    return -sum(d - 9 * (d > 9) for d in doubled) % 10


def country_digits(digits: str) -> int:
    """How many digits the country code of an international number has, by its first ones."""
    return 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGIT_CODES else 3


@functools.cache
def days_alike() -> dict[tuple[bool, bool], list[int]]:
    """The days that can be replaced, by whether day and month have two digits."""
    found: dict[tuple[bool, bool], list[int]] = {}
    for number in range(FIRST_DAY.toordinal(), LAST_DAY.toordinal() + 1):
        day = datetime.date.fromordinal(number)
        found.setdefault((day.day > 9, day.month > 9), []).append(number)
    return found


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _refill(form: str, chars: str) -> str:
    """``form`` with its letters and digits replaced by ``chars`` in turn."""
    new = iter(chars)
    return "".join(next(new) if c.isalnum() else c for c in form)


class Pseudonyms:
    """Finds valid personal values and replaces them."""

    def __init__(self, key: bytes):
        self.permute = Feistel(key)

    def _digits(self, digits: str, kind: str) -> str:
        new = self.permute(int(digits), 10 ** len(digits), f"{kind}{len(digits)}".encode())
        return str(new).zfill(len(digits))

    def _spelled(self, text: str, kind: str) -> str:
        """Characters of the known alphabets permuted together, each within its own."""
        places = [_PLACE[c] for c in text if c in _PLACE]
        bound, value = 1, 0
        for radix, i, _ in places:
            bound, value = bound * radix, value * radix + i
        form = "".join(ALPHABETS[[a[0] for a in ALPHABETS].index(_PLACE[c][2][0])][0] if c in _PLACE else c for c in text)
        value, new = self.permute(value, bound, f"{kind}{form}".encode()), []
        for radix, _, alphabet in reversed(places):
            value, i = divmod(value, radix)
            new.append(alphabet[i])
        spelled = iter(reversed(new))
        return "".join(next(spelled) if c in _PLACE else c for c in text)

    def _uncased(self, text: str, kind: str) -> str:
        """As ``_spelled``, but for the same spelling in lower case; capitals stay where they are."""
        low = "".join(c.lower() if c.lower() in _PLACE else c for c in text)
        return "".join(n.upper() if c != x and len(n.upper()) == 1 else n for c, x, n in zip(text, low, self._spelled(low, kind), strict=True))

    def email(self, found: str) -> str | None:
        """Name and host are permuted, each by itself, so addresses of one host keep one host; the last label stays."""
        name, _, host = found.rpartition("@")
        labels, _, top = host.rpartition(".")
        return f"{self._uncased(name, 'email')}@{self._uncased(labels, 'host')}.{top}"

    def phone(self, found: str) -> str | None:
        digits = re.sub(r"\D", "", found)
        if found[0] != "+":  # the forms without a country code are those of code 1
            return _refill(found, self._digits(digits, "phone1"))
        country = country_digits(digits)
        if not 7 <= len(digits) <= 15 or len(digits) - country < 6:
            return None
        return _refill(found, digits[:country] + self._digits(digits[country:], "phone" + digits[:country]))

    def card(self, found: str) -> str | None:
        digits = re.sub(r"\D", "", found)
        if luhn_digit(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
            return None
        new = self._digits(digits[:-1], "card")
        return _refill(found, new + str(luhn_digit(new)))

    def ip(self, found: str) -> str | None:
        octets = [int(o) for o in found.split(".")]
        if max(octets) > 255 or any(len(o) > 1 and o[0] == "0" for o in found.split(".")):
            return None
        new = self.permute(int.from_bytes(bytes(octets), "big"), 1 << 32, b"ip")
        return ".".join(map(str, new.to_bytes(4, "big")))

    def ssn(self, found: str) -> str | None:
        area, group, serial = map(int, found.split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        rest, serial = divmod(self.permute(value, 898 * 99 * 9999, b"ssn"), 9999)
        area, group = divmod(rest, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def iban(self, found: str) -> str | None:
        plain = found.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _iban_rest(plain) != 1:
            return None
        body = self._spelled(plain[4:], "iban" + plain[:2])
        return _refill(found, f"{plain[:2]}{98 - _iban_rest(plain[:2] + '00' + body):02d}{body}")

    def date(self, found: str) -> str | None:
        sep = re.search(r"\D", found)[0]
        parts = found.split(sep)
        orders = [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 1, 0), (2, 0, 1)]
        for order in orders:
            try:
                day = datetime.date(*(int(parts[i]) for i in order))
            except ValueError:
                continue
            if not FIRST_DAY <= day <= LAST_DAY:
                return None
            form = day.day > 9, day.month > 9
            days = days_alike()[form]
            new = datetime.date.fromordinal(days[self.permute(bisect.bisect_left(days, day.toordinal()), len(days), b"date%d%d" % form)])
            out = ["", "", ""]
            for i, value in zip(order, (new.year, new.month, new.day), strict=True):
                out[i] = str(value).zfill(len(parts[i]))
            return sep.join(out)
        return None

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with pseudonyms, and the number of values of each kind."""
        spans = []
        if "@" in text:
            spans += [(m.start(), m.end(), "email", m[0]) for m in EMAIL.finditer(text)]
        if not text.isascii() or any(d in text for d in "0123456789"):
            spans += [(m.start(), m.end(), "iban", m[0]) for m in IBAN.finditer(text)]
            spans += [(m.start(), m.end(), {"iso": "date", "day": "date"}.get(kind := next(k for k in ("iso", "day", "ssn", "phone", "ip", "card") if m[k]), kind), m[0]) for m in NUMBERS.finditer(text)]
        if not spans:
            return text, {}
        out, at, counts = [], 0, {}
        for start, end, kind, found in sorted(spans):
            if start < at or (new := getattr(self, kind)(found)) is None:
                continue
            out += [text[at:start], new]
            at = end
            counts[kind] = counts.get(kind, 0) + 1
        return "".join([*out, text[at:]]), counts


def pseudonymise(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, plus ``n_pii`` and a count for each kind (``n_email`` and so on).

    Without a key, the session's ``KEY_SETTING`` names it; without that either this
    raises. A null text stays null with counts of 0, an empty one empty; texts
    are read whole, however long. Rows stand by themselves, so equal values get
    equal pseudonyms in any row, partition or run with the same key, and repeated
    rows stay. ``n_chars``, where there is one, follows the text. Columns that are
    already called like an added one are replaced; an empty table gives no rows.
    """
    if key is None:
        named = docs.sparkSession.conf.get(KEY_SETTING, None)
        if not named:
            raise ValueError(f"pseudonyms need a key: pass one or set {KEY_SETTING}")
        key = named.encode()
    docs = docs.drop("n_pii", *(f"n_{k}" for k in KINDS))
    kept = list(docs.columns)
    at = kept.index("text")
    added = ["n_pii", *(f"n_{k}" for k in KINDS)]

    def run(batches):
        change = Pseudonyms(key)
        for b in batches:
            texts, counts = [], []
            for text in b.column(at).to_pylist():
                new, found = (None, {}) if text is None else change.replace(text)
                texts.append(new)
                counts.append((sum(found.values()), *(found.get(k, 0) for k in KINDS)))
            columns = list(b.columns)
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in kept:
                i = kept.index("n_chars")
                columns[i] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(b.schema.field(i).type)
            extra = zip(*counts, strict=True) if counts else [[]] * len(added)
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int32()) for c in extra)], names=[*kept, *added])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + [f"{c} int" for c in added])
    return map_batches(docs, run, schema)


def op10_feistel_pii(spark, sf_dir: str) -> DataFrame:
    """Every document with its personal values replaced, and their counts; by the session's key, or else by ``QUERY_KEY``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    named = spark.conf.get(KEY_SETTING, None)
    return pseudonymise(docs, named.encode() if named else QUERY_KEY).withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
