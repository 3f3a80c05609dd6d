"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Found values are validated (Luhn, IBAN checksum, calendar, ranges) and mapped to
their place in the finite set of valid values of their kind.  A keyed Feistel
network permutes that set: a place is two digits of a mixed radix, and rounds
add a keyed hash of one to the other; places outside the set are permuted again
until they fall inside.  The value at the new place is written in the format
found.  A permutation keeps different values apart, and equal values stay
linked across documents and spellings under one key.

Kinds: card (Luhn, 13 to 19 digits), ssn, phone, ipv4, iban, date (1900 to
2099; year first, or day or month first), email (the part before @).

Defined results: a null text stays null, an empty one empty; values that fail
their check are left; of overlapping finds the first kind of PATTERN at the
leftmost place counts; where a card or IBAN with the groups after it fails, its
shorter beginnings at a separator are tried, and the search goes on behind what
was accepted; repeated rows have equal results; other columns stay.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytewords import text_chunks

ROUNDS = 10
KINDS = ("email", "iban", "date", "ssn", "ipv4", "phone", "card")
_DATE = r"(?:(?P<y1>\d{4})(?P<s1>[-/.])(?P<m1>\d{1,2})(?P=s1)(?P<d1>\d{1,2})|(?P<a2>\d{1,2})(?P<s2>[-/.])(?P<b2>\d{1,2})(?P=s2)(?P<y2>\d{4}))"
PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?!\w))"
    rf"|(?P<date>(?<![\w.+-]){_DATE}(?![\w-]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<ipv4>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w.+-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))"
)
#: Characters of each country's IBAN.
IBAN_SIZES = {
    country: int(size)
    for size, countries in (x.split(":") for x in "15:NO,16:BE,18:DK FI FO GL NL,19:MK SI,20:AT BA EE KZ LT LU XK,21:CH HR LI LV,22:BG BH CR DE GB GE IE ME RS VA,23:AE GI IL IQ TL,24:AD CZ ES MD PK RO SA SE SK TN VG,25:LY PT ST,26:IS TR,27:FR GR IT MC MR SM,28:AL AZ BY CY DO GT HU LB PL SV,29:BR EG PS QA UA,30:JO KW MU,31:MT SC,32:LC".split(","))
    for country in countries.split()
}
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2099, 12, 31).toordinal() - FIRST_DAY + 1


class Permutation:
    """A keyed permutation of range(size)."""

    def __init__(self, key: bytes, kind: str, size: int):
        self.size = size
        self.a = int(size**0.5) if size < 1 << 100 else 1 << (size.bit_length() // 2)
        self.a = max(1, self.a)
        self.b = -(-size // self.a)
        self.key = hashlib.blake2b(f"{kind}:{size}".encode(), key=key[:64], digest_size=32).digest()

    def _round(self, i: int, x: int) -> int:
        data = bytes([i]) + x.to_bytes((x.bit_length() + 7) // 8 + 1, "little")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=64).digest(), "little")

    def _once(self, x: int, back: bool) -> int:
        left, right = divmod(x, self.b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * self._round(i, left)) % self.b
            else:
                left = (left + sign * self._round(i, right)) % self.a
        return left * self.b + right

    def __call__(self, x: int, back: bool = False) -> int:
        x = self._once(x, back)
        while x >= self.size:
            x = self._once(x, back)
        return x


def luhn_digit(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 - i % 2)
        total += n - 9 * (n > 9)
    return -total % 10


def iban_check(country: str, rest: str) -> int:
    digits = "".join(str(int(c, 36)) for c in f"{rest}{country}00")
    return 98 - int(digits) % 97


def beginnings(form: str) -> Iterator[str]:
    """``form`` and its beginnings that end before a separator, the longest first."""
    yield form
    for i in reversed(range(len(form))):
        if form[i] in " -":
            yield form[:i]


def put(form: str, symbols: str, where) -> str:
    """``form`` with the characters that ``where`` accepts replaced in order."""
    it = iter(symbols)
    return "".join(next(it) if where(c) else c for c in form)


class Pseudonyms:
    """Replaces values under one key; ``back`` restores them."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back, self.known = key, back, {}

    def permute(self, kind: str, size: int, x: int) -> int:
        if (kind, size) not in self.known:
            if len(self.known) > 4096:
                self.known.clear()
            self.known[kind, size] = Permutation(self.key, kind, size)
        return self.known[kind, size](x, self.back)

    def digits(self, kind: str, digits: str) -> str:
        return str(self.permute(kind, 10 ** len(digits), int(digits))).zfill(len(digits))

    def email(self, m) -> str | None:
        local, at, host = m["email"].rpartition("@")
        sizes = [26 if c.isalpha() else 10 if c.isdigit() else 1 for c in local]
        x, size = 0, 1
        for c, n in zip(local.lower(), sizes, strict=True):
            x = x * n + (ord(c) - 97 if n == 26 else int(c) if n == 10 else 0)
            size *= n
        kind = "email:" + "".join("a" if n == 26 else "0" if n == 10 else c for c, n in zip(local, sizes, strict=True))
        x, out = self.permute(kind, size, x), []
        for c, n in zip(reversed(local), reversed(sizes), strict=True):
            x, k = divmod(x, n)
            out.append(c if n == 1 else str(k) if n == 10 else chr((65 if c.isupper() else 97) + k))
        return "".join(reversed(out)) + at + host

    def iban(self, m) -> str | None:
        # The beginning of the country's length counts before others.
        forms = sorted(beginnings(m["iban"]), key=lambda f: len(f.replace(" ", "")) != IBAN_SIZES.get(f[:2]))
        return next((new for f in forms if (new := self._iban(f))), None)

    def _iban(self, form: str) -> str | None:
        plain = form.replace(" ", "")
        country, check, rest = plain[:2], plain[2:4], plain[4:]
        if not 15 <= len(plain) <= 34 or int(check) != iban_check(country, rest):
            return None
        x = size = 0
        size = 1
        for c in rest:
            n = 10 if c.isdigit() else 26
            x, size = x * n + (int(c) if n == 10 else ord(c) - 65), size * n
        x, out = self.permute("iban:" + "".join("0" if c.isdigit() else "a" for c in rest), size, x), []
        for c in reversed(rest):
            n = 10 if c.isdigit() else 26
            x, k = divmod(x, n)
            out.append(str(k) if n == 10 else chr(65 + k))
        rest = "".join(reversed(out))
        return put(form, f"{country}{iban_check(country, rest):02d}{rest}", str.isalnum)

    def date(self, m) -> str | None:
        if m["y1"]:
            order, year, month, day = "ymd", m["y1"], m["m1"], m["d1"]
        else:
            a, b, year = m["a2"], m["b2"], m["y2"]
            # Month first only where the second number can't be a month and the sign is a slash or dash.
            order = "mdy" if int(b) > 12 and m["s2"] != "." else "dmy"
            month, day = (a, b) if order == "mdy" else (b, a)
        try:
            at = datetime.date(int(year), int(month), int(day)).toordinal() - FIRST_DAY
        except ValueError:
            return None
        if not 0 <= at < DAYS:
            return None
        # A date that could be read both ways keeps a first number of at most 12, so that it reads the same way afterwards.
        new = datetime.date.fromordinal(self.permute("date", DAYS, at) + FIRST_DAY)
        padded = all(len(x) == 2 for x in (month, day))
        show = (lambda x: f"{x:02d}") if padded or order == "ymd" else str
        parts = {"y": f"{new.year:04d}", "m": show(new.month), "d": show(new.day)}
        if order == "mdy" and new.day <= 12:
            order = "dmy"
        return (m["s1"] or m["s2"]).join(parts[c] for c in order)

    def ssn(self, m) -> str | None:
        area, group, serial = (int(x) for x in m["ssn"].split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(self.permute("ssn", 898 * 99 * 9999, x), 9999)
        area, group = divmod(x, 99)
        area += 1 + (area >= 665)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"

    def ipv4(self, m) -> str | None:
        parts = [int(x) for x in m["ipv4"].split(".")]
        if max(parts) > 255:
            return None
        x = self.permute("ipv4", 1 << 32, int.from_bytes(bytes(parts), "big"))
        return ".".join(str(b) for b in x.to_bytes(4, "big"))

    def phone(self, m) -> str | None:
        text = m["phone"]
        code = re.match(r"\+\d{1,3}(?=[ .(-])", text)
        head = code[0] if code else "+" if text[0] == "+" else ""
        rest = text[len(head) :]
        digits = re.sub(r"\D", "", rest)
        if not 7 <= len(digits) <= 15:
            return None
        return head + put(rest, self.digits("phone", digits), str.isdigit)

    def card(self, m) -> str | None:
        return next((new for f in beginnings(m["card"]) if (new := self._card(f))), None)

    def _card(self, form: str) -> str | None:
        digits = re.sub(r"\D", "", form)
        if len(digits) < 13 or luhn_digit(digits[:-1]) != int(digits[-1]) or not int(digits):
            return None
        body = self.digits("card", digits[:-1])
        return put(form, body + str(luhn_digit(body)), str.isdigit)

    def replace(self, text: str) -> tuple[str, list[str]]:
        """The text with pseudonyms, and the kinds found in order."""
        found: list[str] = []
        parts: list[str] = []
        done = at = 0
        while m := PATTERN.search(text, at):
            kind = m.lastgroup if m.lastgroup in KINDS else next(k for k in KINDS if m[k] is not None)
            new = getattr(self, kind)(m)
            if new is None:
                at = m.start() + 1
                continue
            found.append(kind)
            parts += text[done : m.start()], new
            # Cards and IBANs keep their length, and may be a beginning of the match.
            done = at = m.start() + len(new) if kind in ("card", "iban") else m.end()
        return "".join([*parts, text[done:]]), found


def candidates(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that have an at sign or four digits."""
    digits = np.concatenate(([0], np.cumsum((data >= 0x30) & (data <= 0x39))))
    ats = np.concatenate(([0], np.cumsum(data == 0x40)))
    return (np.diff(digits[offsets]) >= 4) | (np.diff(ats[offsets]) > 0)


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with pseudonyms, n_found, and a count for each kind."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for batch in batches:
            for c in text_chunks(batch.column("text")):
                rows = slice(c.lo, c.hi)
                texts = batch.column("text")[rows].to_pylist()
                counts = np.zeros((len(texts), len(KINDS)), dtype=np.int64)
                for i in np.flatnonzero(candidates(c.data, c.offsets)):
                    texts[i], found = names.replace(texts[i])
                    for kind in found:
                        counts[i, KINDS.index(kind)] += 1
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[rows], pa.array(texts, type=pa.string()), pa.array(counts.sum(1)), *(pa.array(counts[:, k]) for k in range(len(KINDS)))], names=["doc_id", "text", "n_found", *(f"n_{k}" for k in KINDS)])

    schema = "doc_id long, text string, n_found long, " + ", ".join(f"n_{k} long" for k in KINDS)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(of, schema)


def op6_pseudonyms(spark, sf_dir: str, key: bytes = b"a key for tests; give your own") -> DataFrame:
    return pseudonymize(spark.read.parquet(f"{sf_dir}/documents.parquet"), key)
