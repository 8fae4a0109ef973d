"""Format-preserving pseudonyms for personal data.

Validated finds are permuted by a keyed Feistel network within the set of values of their own format, so a pseudonym is
again a valid value of that format and equal values get equal pseudonyms in all documents:

- card numbers (Luhn): the digits after the first, with a new check digit;
- North American phone numbers: area code, exchange and line; other numbers after + and a country code: all digits after it;
  numbers in the home formats of France, Spain, Germany and Britain: the digits after the first (or after the 0);
- dates (ISO, day.month.year, month/day/year and, where that is no date, day/month/year) from 1900 to 2099: the day, to
  one that is written with as many digits;
- IPv4 addresses: the four numbers, to others of as many digits;  e-mail addresses: letters by letters, digits by digits, the top-level domain kept;
- IBANs (mod 97): the account part, with new check digits;  US social security numbers;
- secrets (access keys, tokens and passwords after their name in any case): letters by letters, digits by digits.

A network walks a power of four at least as large as the set until it is back inside ("cycle walking"), which makes it a
permutation of the set; ``Pseudonyms(key, back=True)`` walks the other way.  Letters and digits of long values go in
blocks of ``BLOCK``; what comes before a block and the shape of the whole value choose the block's permutation.  Values may
have any length, and the search takes time in proportion to the text.  Digits are ASCII digits.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from passages.llm.common import bounded_batches, give_back

ROUNDS = 8
#: Characters that one network permutes together.
BLOCK = 64
#: Longest value that is remembered.
REMEMBERED = 256
#: Where the session names the secret key; the default key is public and only for tests.
KEY_SETTING = "spark.passages.pseudonym.key"
DEFAULT_KEY = b"change this key"
_DAY0, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()
_DIGIT, _LOWER, _UPPER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"

_KINDS = {
    "secret": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|(?:(?<=(?i:token = \"))|(?<=(?i:token=))|(?<=(?i:password=))|(?<=(?i:password: ))|(?<=(?i:passwd=))|(?<=(?i:secret=))|(?<=(?i:api_key=))|(?<=(?i:apikey=))|(?<=(?i:secret = \"))|(?<=(?i:password = \"))|(?<=(?i:api_key = \")))[A-Za-z0-9_\-]{8,}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
    "iso": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])",
    "us": r"(?<![\d/])\d{1,2}/\d{1,2}/\d{4}(?![\d/])",
    "eu": r"(?<![\d.])\d{1,2}\.\d{1,2}\.\d{4}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "abroad": r"(?<![\d+])\+(?:1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|[2-9](?:[ ./-]?\(?\d\)?){7,14})(?!\d)",
    "fr": r"(?<![\w+.,/-])(?:0[1-9](?:([ .-])\d{2}(?:\1\d{2}){3})|0[67]\d{8})(?![\w]|[.,-]\d)",
    "es": r"(?<![\w+.,/-])[6-9]\d{2}(?: \d{2}){3}(?![\w]|[ .,-]\d)",
    "home": r"(?<![\w+.,/-])(?:\(0\d{2,4}\) ?|0\d{2,4}[ /-])\d{3,8}(?:[ -]\d{3,6})?(?![\w]|[ .,/-]\d)",
    "phone": r"(?<![\d+])(?:\+?1[ .-]?)?\(?[2-9]\d{2}\)?[ .-]?[2-9]\d{2}[ .-]?\d{4}(?!\d)",
}
_FINDS = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _KINDS.items()).replace(r"\1", r"(?P=_gap)").replace("([ .-])", "(?P<_gap>[ .-])"), re.ASCII)
#: An address after its local part, from the sign on; the local part is read backwards from there.
_DOMAINS = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}").finditer
_LOCAL = frozenset(_DIGIT + _LOWER + _UPPER + "._%+-")
#: The kinds that are tried where one was found but is not valid.
_AFTER = {k: [(x, re.compile(_KINDS[x], re.ASCII)) for x in list(_KINDS)[i + 1 :]] for i, k in enumerate(_KINDS)}
_BORDER = re.compile(r"[ -]")
_ANY = re.compile(r"[0-9]|@|A[KS]IA|(?i:token|password|passwd|secret|api_?key) ?[=:]").search
#: Country codes of one and two digits; the others have three.
_COUNTRIES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
KINDS = ("email", "secret", "iban", "ip", "date", "ssn", "card", "phone")


class Pseudonyms:
    """A keyed permutation for each format, or its inverse if ``back``.  ``most`` pseudonyms are remembered."""

    def __init__(self, key: bytes, most: int = 20_000, back: bool = False):
        self.key, self.most, self.back, self.known = hashlib.blake2b(key, digest_size=32).digest(), most, back, {}

    def permute(self, x: int, size: int, tweak: str) -> int:
        """x in range(size), to another place in it."""
        if size < 2:
            return x
        half = ((size - 1).bit_length() + 1) // 2
        mask, n = (1 << half) - 1, (half + 7) // 8
        seeds = [b"%d|%d|%s|" % (i, size, tweak.encode()) for i in range(ROUNDS)]
        f = lambda seed, right: int.from_bytes(hashlib.blake2b(seed + right.to_bytes(n, "little"), key=self.key, digest_size=n).digest(), "little") & mask
        while True:
            left, right = x >> half, x & mask
            if self.back:
                for seed in reversed(seeds):
                    left, right = right ^ f(seed, left), left
            else:
                for seed in seeds:
                    left, right = right, left ^ f(seed, right)
            x = left << half | right
            if x < size:
                return x

    def _chars(self, text: str, tweak: str, alphabets: tuple[str, ...] = (_DIGIT, _LOWER, _UPPER)) -> str:
        """Each character of an alphabet becomes one of the same alphabet; the others stay."""
        place = {c: (a, i) for a in reversed(alphabets) for i, c in enumerate(a)}
        shape = "".join(str(len(place[c][0])) if c in place else c for c in text)
        if len(text) <= BLOCK:
            return self._block(text, f"{tweak}:{shape}", place)
        before, out = hashlib.blake2b(f"{tweak}:{shape}".encode("utf-8", "surrogatepass"), digest_size=16), []
        for at in range(0, len(text), BLOCK):
            old = text[at : at + BLOCK]
            out.append(self._block(old, before.hexdigest(), place))
            before.update((out[-1] if self.back else old).encode("utf-8", "surrogatepass"))
        return "".join(out)

    def _block(self, text: str, tweak: str, place: dict[str, tuple[str, int]]) -> str:
        x, size = 0, 1
        for c in text:
            if c in place:
                a, i = place[c]
                x, size = x * len(a) + i, size * len(a)
        x = self.permute(x, size, tweak)
        out = []
        for c in reversed(text):
            if c in place:
                a = place[c][0]
                x, r = divmod(x, len(a))
                c = a[r]
            out.append(c)
        return "".join(reversed(out))

    def _walk(self, value: str, step: Callable[[str], str], ok: Callable[[str], bool]) -> str:
        """The next value on the permutation's cycle that is of the set again."""
        while not ok(value := step(value)):
            pass
        return value

    @staticmethod
    def _with_digits(text: str, digits: str) -> str:
        it = iter(digits)
        return "".join(next(it) if c.isdigit() else c for c in text)

    def _date(self, y: int, m: int, d: int, ok: Callable[[datetime.date], bool] = lambda day: True) -> datetime.date | None:
        """Another date of those that are ``ok``, as this one must be."""
        try:
            day = datetime.date(y, m, d).toordinal() - _DAY0
        except ValueError:
            return None
        if not 0 <= day < _DAYS:
            return None
        while True:
            day = self.permute(day, _DAYS, "date")
            if ok(new := datetime.date.fromordinal(_DAY0 + day)):
                return new

    def of(self, kind: str, text: str) -> tuple[str, str] | None:
        """(kind, pseudonym), or None if the find is not valid."""
        if len(text) > REMEMBERED:
            return getattr(self, f"_{kind}")(text)
        if (kind, text) not in self.known:
            if len(self.known) > self.most:
                self.known = {}
            self.known[kind, text] = getattr(self, f"_{kind}")(text)
        return self.known[kind, text]

    def _email(self, t: str):
        local, _, domain = t.rpartition("@")
        host, _, top = domain.rpartition(".")
        return "email", f"{self._chars(local, 'local')}@{self._chars(host, 'host')}.{top}"

    def _secret(self, t: str):
        if t[:4] in ("AKIA", "ASIA") and len(t) == 20:
            return "secret", t[:4] + self._chars(t[4:], "access key")
        own = _alphabets(t)
        return own and ("secret", self._walk(t, lambda x: self._chars(x, "secret", own), lambda x: _alphabets(x) == own))

    def _iban(self, t: str):
        flat = t.replace(" ", "")
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
            return None
        account = self._chars(flat[4:], "iban" + flat[:2])
        new = iter(f"{flat[:2]}{98 - number(account + flat[:2] + '00') % 97:02d}{account}")
        return "iban", "".join(c if c == " " else next(new) for c in t)

    def _ip(self, t: str):
        parts = t.split(".")
        if any(int(p) > 255 for p in parts):
            return None
        if any(p[0] == "0" and len(p) > 1 for p in parts):  # leading zeros: each number below 256
            ranges = [(0, 256 if len(p) == 3 else 10 ** len(p)) for p in parts]
        else:
            ranges = [((0, 10), (10, 100), (100, 256))[len(p) - 1] for p in parts]
        x = 0
        for p, (low, high) in zip(parts, ranges, strict=True):
            x = x * (high - low) + int(p) - low
        whole = 1
        for low, high in ranges:
            whole *= high - low
        out, ok = [], False
        while not ok:
            x = self.permute(x, whole, "ip" + "".join(str(len(p)) for p in parts))
            out, rest = [], x
            for p, (low, high) in zip(reversed(parts), reversed(ranges), strict=True):
                rest, own = divmod(rest, high - low)
                out.append(f"{own + low:0{len(p)}d}")
            ok = any(p[0] == "0" and len(p) > 1 for p in parts) == any(p[0] == "0" and len(p) > 1 for p in out)
        return "ip", ".".join(reversed(out))

    def _iso(self, t: str):
        new = self._date(int(t[:4]), int(t[5:7]), int(t[8:]))
        return new and ("date", new.isoformat())

    def _us(self, t: str):
        m, d, y = t.split("/")
        if int(m) > 12:  # day/month: to another date that cannot be month/day
            new = self._date(int(y), int(d), int(m), lambda x: x.day > 12 and (len(d) == 2 or x.month < 10))
            return new and ("date", f"{new.day:0{len(m)}d}/{new.month:0{len(d)}d}/{new.year}")
        new = self._date(int(y), int(m), int(d), lambda x: _written_alike((x.month, x.day), (m, d)))
        return new and ("date", f"{new.month:0{len(m)}d}/{new.day:0{len(d)}d}/{new.year}")

    def _eu(self, t: str):
        d, m, y = t.split(".")
        new = self._date(int(y), int(m), int(d), lambda x: _written_alike((x.month, x.day), (m, d)))
        return new and ("date", f"{new.day:0{len(d)}d}.{new.month:0{len(m)}d}.{new.year}")

    def _ssn(self, t: str):
        area, group, serial = map(int, t.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        areas = [a for a in range(1, 900) if a != 666]
        x = self.permute((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999, "ssn")
        x, s = divmod(x, 9999)
        a, g = divmod(x, 99)
        return "ssn", f"{areas[a]:03d}-{g + 1:02d}-{s + 1:04d}"

    def _card(self, t: str):
        d = "".join(c for c in t if c.isdigit())
        if not 13 <= len(d) <= 19 or d[0] == "0" or _luhn(d):
            return None
        new = d[0] + f"{self.permute(int(d[1:-1]), 10 ** (len(d) - 2), f'card{len(d)}'):0{len(d) - 2}d}"
        return "card", self._with_digits(t, new + str(_luhn(new + "0") and 10 - _luhn(new + "0")))

    def _phone(self, t: str):
        d = "".join(c for c in t if c.isdigit())
        own = d[-10:]
        if len(own) < 10 or own[0] in "01" or own[3] in "01":
            return None
        x = (int(own[:3]) - 200) * 800 * 10**4 + (int(own[3:6]) - 200) * 10**4 + int(own[6:])
        x, line = divmod(self.permute(x, 800 * 800 * 10**4, "phone"), 10**4)
        area, exchange = divmod(x, 800)
        return "phone", self._with_digits(t, f"{d[:-10]}{area + 200}{exchange + 200}{line:04d}")

    def _abroad(self, t: str):
        d = "".join(c for c in t if c.isdigit())
        if national := d[0] == "1" and self._phone(t):
            return national
        code = next((c for c in (d[:1], d[:2]) if c in _COUNTRIES), d[:3])
        own = d[len(code) :]
        while True:  # a number after +1 that no area has, to another such
            own = f"{self.permute(int(own), 10 ** len(own), f'phone{code}'):0{len(own)}d}"
            if code != "1" or own[0] in "01" or own[3] in "01":
                return "phone", self._with_digits(t, code + own)

    def _inland(self, t: str, kept: int, first: str, kind: str):
        """The digits after the first ``kept``, to others that begin with one of ``first``."""
        d = "".join(c for c in t if c.isdigit())
        own = self._walk(d[kept:], lambda x: f"{self.permute(int(x), 10 ** len(x), kind):0{len(x)}d}", lambda x: x[0] in first)
        return "phone", self._with_digits(t, d[:kept] + own)

    def _fr(self, t: str):
        if t[1] in "67" and t[2].isdigit():  # without gaps: a mobile number again
            return self._inland(t, 1, "67", "phone fr")
        return self._inland(t, 1, _DIGIT[1:], "phone fr")

    def _es(self, t: str):
        return self._inland(t, 0, "6789", "phone es")

    def _home(self, t: str):
        d = "".join(c for c in t if c.isdigit())
        return self._inland(t, 1, _DIGIT[1:], "phone home") if 9 <= len(d) <= 12 and d[1] != "0" else None

    def text(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with pseudonyms, and how many of each kind it has."""
        counts: dict[str, int] = {}
        if not _ANY(text):
            return text, counts

        out, done, at = [], 0, 0
        addresses, address, m = _addresses(text), None, None
        while True:
            while address := address or next(addresses, None):
                address = (max(at, address[0]), address[1], address[2])
                if address[0] < address[1]:
                    break
                address = None  # nothing of the local part is left
            if m is None or m.start() < at:
                m = _FINDS.search(text, at) or _NONE
            if address and address[0] <= m.start():
                start, end = address[0], address[2]
                got = self._valid("email", text[start:end])
            elif m is _NONE:
                break
            else:
                start, kind = m.start(), next(k for k in _KINDS if m[k] is not None)
                got = self._valid(kind, m[0])
                if not got:
                    later = ((k, n) for k, p in _AFTER[kind] if (n := p.match(text, start)))
                    got = next((g for k, n in later if (g := self._valid(k, n[0]))), None)
            if not got:
                at = start + 1
                continue
            (kind, new), size = got
            out += text[done:start], new
            done = at = start + size
            counts[kind] = counts.get(kind, 0) + 1
        return "".join(out) + text[done:], counts

    def _valid(self, kind: str, found: str) -> tuple[tuple[str, str], int] | None:
        """What the find becomes and how much of it; numbers that run into others are tried up to each border, the longest first."""
        ends = [len(found)]
        if kind in ("card", "iban"):
            ends += [b.start() for b in _BORDER.finditer(found, 13)][::-1]
        return next(((got, n) for n in ends if (got := self.of(kind, found[:n]))), None)


class _Nothing:
    """Stands for a match past the end."""

    @staticmethod
    def start() -> int:
        return 1 << 62


_NONE = _Nothing()


def _addresses(text: str) -> Iterator[tuple[int, int, int]]:
    """Start, end of the local part and end of each e-mail address."""
    for m in _DOMAINS(text):
        start = m.start()
        while start and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.start(), m.end()


def _alphabets(secret: str) -> tuple[str, ...] | None:
    """What a secret is written in; None for one without a digit."""
    own = set(secret)
    if not own & set(_DIGIT):
        return None
    return next(((a,) for a in (_DIGIT, _HEX.upper(), _HEX) if own <= set(a)), (_DIGIT, _LOWER, _UPPER))


def _written_alike(numbers: tuple[int, int], digits: tuple[str, str]) -> bool:
    """Whether two numbers can be written with as many digits; a leading zero beside a single digit stays one."""
    if len(digits[0]) == len(digits[1]):
        return len(digits[0]) == 2 or max(numbers) < 10
    return all(n < 10 if len(t) == 1 else (n < 10) == (t[0] == "0") for n, t in zip(numbers, digits, strict=True))


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names, else the public one, with a warning."""
    if own := spark.conf.get(KEY_SETTING, None):
        return own.encode()
    warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are made with the public default key", stacklevel=3)
    return DEFAULT_KEY


def _luhn(digits: str) -> int:
    """The Luhn sum modulo 10; 0 for a valid number."""
    return sum(n if i % 2 == 0 else sum(divmod(2 * n, 10)) for i, n in enumerate(map(int, reversed(digits)))) % 10


def pseudonymise(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """doc_id, text with pseudonyms, n_finds, and a count for each kind, of each row.

    A null text stays null and has no find; a null doc_id stays null; repeated rows get the same pseudonyms; an empty
    table gives no rows; further columns of ``docs`` are not read.  The key decides the pseudonyms: keep it secret.
    Without one it is what the session has under ``KEY_SETTING``.
    """
    bounded_batches(docs.sparkSession)
    key = session_key(docs.sparkSession) if key is None else key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonyms(key)
        for batch in batches:
            rows = [(None, {}) if t is None else own.text(t) for t in batch.column(1).to_pylist()]
            arrays = [batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([sum(r[1].values()) for r in rows], pa.int64())]
            arrays += [pa.array([r[1].get(k, 0) for r in rows], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text", "n_finds", *(f"n_{k}" for k in KINDS)])

    schema = "doc_id long, text string, n_finds long, " + ", ".join(f"n_{k} long" for k in KINDS)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, schema)


def with_pseudonyms(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """docs with the text column replaced; n_chars, where there is one, is the new text's length.

    All rows stay, in their order, with null and repeated ids and null texts as they are; an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    key = session_key(docs.sparkSession) if key is None else key
    names = docs.columns
    at, length = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonyms(key)
        for batch in batches:
            texts = [None if t is None else own.text(t)[0] for t in batch.column(at).to_pylist()]
            arrays = list(batch.columns)
            arrays[at] = pa.array(texts, batch.schema.field(at).type)
            if length >= 0:
                arrays[length] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        give_back()

    return docs.mapInArrow(run, docs.schema)


__all__ = ["Pseudonyms", "pseudonymise", "with_pseudonyms"]
