"""Personal data replaced by format-preserving pseudonyms from a keyed Feistel permutation.

A value is found by its form and must pass validation: the check digit of a card number, the check digits of an IBAN, the number ranges of
telephone, social security and IP numbers, the calendar for dates. It is then read as a number below the size of its format's domain; a
balanced Feistel network with keyed rounds permutes that domain (walking on until the result falls inside), and
the result is written in the same form, with valid check digits, the same separators and the same case. Equal values of one kind get
equal pseudonyms in all documents, so records stay linked; without the key they cannot be told, and distinct
values stay distinct. Numbers that fail validation are left alone.

Dates move within 1900-2099, those with one-digit parts among dates with one-digit parts; months may be names in English, German, French
or Spanish. One date in two forms gets two pseudonyms. E-mail local parts, keys with a known prefix and secrets of mixed case are
permuted character class by character class, as are the values of passwords (``password=...``); hexadecimal secrets and the digits of IPv6
addresses are permuted as numbers. National telephone numbers are those with a leading 0 and an area code set apart.

Defined cases: a null text stays null; texts of any length are read whole; repeated rows are treated alike; an empty table gives
an empty result; extra columns are carried through, whatever their names.
"""

from __future__ import annotations

import datetime
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quayside.llm.common import fresh, relaxed


class Feistel:
    """A keyed permutation of 0 .. size - 1: two halves of about the square root of the size, ten rounds."""

    def __init__(self, key: bytes, label: str, size: int, rounds: int = 10):
        self.size, self.rounds, self.label = size, rounds, label.encode()
        self.side = isqrt(size - 1) + 1 if size > 1 else 1
        self.key = blake2b(key, digest_size=32).digest()

    def _round(self, k: int, half: int) -> int:
        told = b"%s|%d|%d|%d" % (self.label, self.size, k, half)
        return int.from_bytes(blake2b(told, key=self.key, digest_size=16).digest(), "big") % self.side

    def _once(self, x: int) -> int:
        a, b = divmod(x, self.side)
        for k in range(self.rounds):
            a, b = b, (a + self._round(k, b)) % self.side
        return a * self.side + b

    def _back(self, x: int) -> int:
        a, b = divmod(x, self.side)
        for k in reversed(range(self.rounds)):
            a, b = (b - self._round(k, a)) % self.side, a
        return a * self.side + b

    def encrypt(self, x: int) -> int:
        x = self._once(x)
        while x >= self.size:
            x = self._once(x)
        return x

    def decrypt(self, x: int) -> int:
        x = self._back(x)
        while x >= self.size:
            x = self._back(x)
        return x


def luhn(digits: str) -> int:
    """Sum of a card number; a multiple of ten if it is valid."""
    doubled = (int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits)))
    return sum(d - 9 * (d > 9) for d in doubled) % 10


def _refill(form: str, digits: str) -> str:
    """The digits put where ``form`` has digits."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in form)


def _iban_rest(bban: str, country: str, check: str) -> int:
    return int("".join(str(int(c, 36)) for c in bban + country + check)) % 97


#: First and last day of the date domain.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
#: Names of the months by language, long and short. A name stands for the first list that has it, and
#: dates move among the months of that list.
_MONTHS = [
    "January February March April May June July August September October November December",
    "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec",
    "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    "Jan Feb Mär Apr Mai Jun Jul Aug Sep Okt Nov Dez",
    "Janvier Février Mars Avril Mai Juin Juillet Août Septembre Octobre Novembre Décembre",
    "Enero Febrero Marzo Abril Mayo Junio Julio Agosto Septiembre Octubre Noviembre Diciembre",
    "Sept",
]
#: As written -> (list and case, month).
MONTHS: dict[str, tuple[tuple[int, int], int]] = {}
for _k, _names in enumerate(_MONTHS):
    for _month, _name in enumerate(_names.split(), 1 if _names != "Sept" else 9):
        for _case, _written in enumerate((_name, _name.lower(), _name.upper())):
            MONTHS.setdefault(_written, ((_k, _case), _month))
_NAME = r"[^\W\d_]{3,10}"
_DAY = r"\d{1,2}(?:st|nd|rd|th)?"


@lru_cache(1000)
def _days(months: tuple[int, ...], least: int, most: int) -> list[int]:
    """Days of the date domain with these months and a day of the month from ``least`` to ``most``."""
    days = (FIRST_DAY + datetime.timedelta(days=d) for d in range((LAST_DAY - FIRST_DAY).days + 1))
    return [(d - FIRST_DAY).days for d in days if d.month in months and least <= d.day <= most]


def _ordinal(day: int) -> str:
    return "th" if 10 < day < 14 else {1: "st", 2: "nd", 3: "rd"}.get(day % 10, "th")


class Pseudonyms:
    """Replaces what it recognises in a text; ``inverse`` turns pseudonyms back into values."""

    def __init__(self, key: bytes, inverse: bool = False):
        self.key, self.inverse = key, inverse
        self.networks: dict[tuple[str, int], Feistel] = {}
        edge, end = r"(?<![\w@.+-])", r"(?![\w@]|[.-]\w)"
        self.kinds: list[tuple[str, re.Pattern, Callable[[re.Match], str | None]]] = [
            ("email", re.compile(r"(?<![\w.+@-])[\w.+-]*\w[\w.+-]*@(?:[\w-]+\.)+[A-Za-z]{2,}"), self._email),
            ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]){11,30}\b"), self._iban),
            ("secret", re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])"), self._secret),
            ("ip", re.compile(edge + r"\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"), self._ip),
            ("token", re.compile(r"(?<![0-9A-Za-z])(?:(AKIA|ASIA)[0-9A-Z]{16}|(gh[pousr]_|github_pat_|glpat-|xox[abeprs]-|sk-|[sr]k_(?:live|test)_|AIza)[0-9A-Za-z_-]{20,255}|[0-9A-Za-z]{32,255})(?![0-9A-Za-z])"), self._token),
            ("date", re.compile(r"(?<![^\W_])(?<![@.+-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![^\W_T]|T(?!\d)|[-/.]\d)"), self._date),
            ("named date", re.compile(rf"(?<!\w)(?:({_DAY})(\.? |-|\.? de | of )({_NAME})(\.?,? |-| de | del )(\d{{4}})|({_NAME})(\.? |-)({_DAY})(,? |-)(\d{{4}}))(?!\w)"), self._named_date),
            ("ssn", re.compile(edge + r"\d{3}-\d{2}-\d{4}" + end), self._ssn),
            ("phone", re.compile(r"(?<![\w.+-])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|(?:1[ .-])?(?:\(\d{3}\) ?\d{3}[ .-]|\d{3}[.-]\d{3}[.-])\d{4}|(?<!\d )(?:1[ .-])?\d{3} \d{3}[ .-]\d{4}(?! \d))(?!\w|[.-]\d)"), self._phone),
            ("foreign phone", re.compile(r"(?<![\w.+-])\+(?:7|[2-9]\d)(?:[ .-]?\(?\d\)?){6,12}(?!\w|[.-]\d)"), self._foreign),
            ("card", re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?!\w|[.-]\d)"), self._card),
            ("ipv6", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)"), self._ipv6),
            ("national phone", re.compile(r"(?<![\w.+/-])0[1-9]\d{1,3}(?: ?[/-] ?| )\d{3}(?: ?\d){2,6}(?!\w|[.:/-]\d| \d)"), self._national),
            ("password", re.compile(r"(?<![\w-])(?:password|passwd|passphrase|pwd|secret|api[_-]?key|access[_-]?key|access[_-]?token|auth[_-]?token)(?:=|\s*[=:]\s*(?=[\"']))([\"']?)([^\s\"'<>&,;]{6,128})\1", re.I), self._password),
        ]

    def _permute(self, kind: str, size: int, x: int) -> int:
        network = self.networks.get((kind, size)) or self.networks.setdefault((kind, size), Feistel(self.key, kind, size))
        return network.decrypt(x) if self.inverse else network.encrypt(x)

    def _digits(self, kind: str, digits: str) -> str:
        return str(self._permute(kind, 10 ** len(digits), int(digits))).zfill(len(digits))

    def _card(self, m: re.Match) -> str | None:
        digits = re.sub(r"\D", "", m[0])
        if luhn(digits) or len(set(digits)) == 1:
            return None
        body = self._digits("card", digits[:-1])
        while len(set(body)) == 1:  # a number of one digit is not recognised again
            body = self._digits("card", body)
        return _refill(m[0], body + str(-luhn(body + "0") % 10))

    def _iban(self, m: re.Match) -> str | None:
        plain = re.sub("[ -]", "", m[0])
        country, check, bban = plain[:2], plain[2:4], plain[4:]
        if _iban_rest(bban, country, check) != 1:
            return None
        digits = "".join(c for c in bban if c.isdigit())
        bban = _refill(bban, self._digits("iban", digits)) if digits else bban
        check = f"{98 - _iban_rest(bban, country, '00'):02d}"
        new = iter(country + check + bban)
        return "".join(c if c in " -" else next(new) for c in m[0])

    def _ip(self, m: re.Match) -> str | None:
        parts = [int(x) for x in m[0].split(".")]
        if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in m[0].split(".")):
            return None
        x = self._permute("ip", 2**32, int.from_bytes(bytes(parts), "big"))
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _date(self, m: re.Match) -> str | None:
        gap = m[1] or m[2]
        a, b, c = map(int, m[0].split(gap))
        forms = ["ymd"] if m[1] else ["mdy", "dmy"] if gap == "/" else ["dmy", "mdy"]
        wide = [len(x) == 2 for x in m[0].split(gap) if len(x) < 4]
        for form in forms:
            year, month, day = (a, b, c) if form == "ymd" else (c, a, b) if form == "mdy" else (c, b, a)
            try:
                date = datetime.date(year, month, day)
            except ValueError:
                continue
            if not FIRST_DAY <= date <= LAST_DAY:
                return None
            two = dict(zip(form.replace("y", ""), wide))  # parts keep their width
            least = 1 if form == forms[0] else 13  # must be read the same way again
            new = self._move(f"date {form}" if least > 1 else "date", date, tuple(range(1, 13 if two["m"] else 10)), least, 31 if two["d"] else 9)
            parts = {"y": f"{new.year:04d}", "m": f"{new.month:0{1 + two['m']}d}", "d": f"{new.day:0{1 + two['d']}d}"}
            return gap.join(parts[c] for c in form)
        return None

    def _move(self, kind: str, date: datetime.date, months: tuple[int, ...], least: int, most: int) -> datetime.date:
        days = _days(months, least, most)
        return FIRST_DAY + datetime.timedelta(days=days[self._permute(kind, len(days), bisect_left(days, (date - FIRST_DAY).days))])

    def _named_date(self, m: re.Match) -> str | None:
        day, gap, name, gap2, year = m.groups()[:5] if m[1] else (m[8], m[7], m[6], m[9], m[10])
        if name not in MONTHS:
            return None
        digits, (style, month) = day.rstrip("stndrh"), MONTHS[name]
        try:
            date = datetime.date(int(year), month, int(digits))
        except ValueError:
            return None
        if not FIRST_DAY <= date <= LAST_DAY or (digits != day and day != digits + _ordinal(date.day)):
            return None
        names = {k: written for written, (s, k) in MONTHS.items() if s == style}
        new = self._move(f"named date {style}", date, tuple(sorted(names)), 1, 31 if len(digits) == 2 else 9)
        day = f"{new.day:0{len(digits)}d}" + (_ordinal(new.day) if digits != day else "")
        first, second = (day, names[new.month]) if m[1] else (names[new.month], day)
        return f"{first}{gap}{second}{gap2}{new.year:04d}"

    def _ssn(self, m: re.Match) -> str | None:
        area, group, serial = map(int, m[0].split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        areas = [a for a in range(1, 900) if a != 666]
        x = (areas.index(area) * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(self._permute("ssn", len(areas) * 99 * 9999, x), 9999)
        return f"{areas[x // 99]:03d}-{x % 99 + 1:02d}-{serial + 1:04d}"

    def _phone(self, m: re.Match) -> str | None:
        digits = re.sub(r"\D", "", m[0])
        own, lead = digits[-10:], digits[:-10]
        if m[0][0] == "+":  # written with the country code, any ten digits are a number
            return _refill(m[0], lead + self._digits("phone with country", own))
        if own[0] in "01" or own[3] in "01":
            return None
        x = ((int(own[:3]) - 200) * 800 + int(own[3:6]) - 200) * 10_000 + int(own[6:])
        x, last = divmod(self._permute("phone", 800 * 800 * 10_000, x), 10_000)
        return _refill(m[0], f"{lead}{x // 800 + 200:03d}{x % 800 + 200:03d}{last:04d}")

    def _foreign(self, m: re.Match) -> str | None:
        digits = re.sub(r"\D", "", m[0])
        code = 1 if digits[0] == "7" else 2
        return _refill(m[0], digits[:code] + self._digits("foreign phone", digits[code:]))

    def _ipv6(self, m: re.Match) -> str | None:
        """The digits that are written stay as many; two ways to write an address give two pseudonyms."""
        try:
            ipaddress.IPv6Address(m[0])
        except ValueError:
            return None
        digits = m[0].replace(":", "")
        if len(digits) < 4 or not re.search("[0-9]", digits):
            return None
        x = int(digits, 16)
        while True:  # an address is told from words by a decimal digit
            x = self._permute("ipv6", 16 ** len(digits), x)
            new = f"{x:0{len(digits)}x}"
            if re.search("[0-9]", new):
                break
        new = iter(new.upper() if m[0].isupper() else new)
        return "".join(c if c == ":" else next(new) for c in m[0])

    def _national(self, m: re.Match) -> str | None:
        """A number with a leading 0 and an area code; both zeros and the first digit's not being one stay."""
        digits = re.sub(r"\D", "", m[0])[1:]
        least = 10 ** (len(digits) - 1)
        return _refill(m[0], f"0{least + self._permute('national phone', 9 * least, int(digits) - least)}")

    def _password(self, m: re.Match) -> str | None:
        new = self._by_class("password", m[2], self._permute)
        return None if new is None else m[0][: m.start(2) - m.start()] + new + m[0][m.end(2) - m.start() :]

    def _secret(self, m: re.Match) -> str | None:
        if m[0].isdigit():
            return None
        x = self._permute("secret", 16 ** len(m[0]), int(m[0], 16))
        text = f"{x:0{len(m[0])}x}"
        return text.upper() if m[0].isupper() else text

    def _email(self, m: re.Match) -> str | None:
        """Letters of the local part stay letters, digits digits; the domain stays."""
        local, domain = m[0].rsplit("@", 1)
        new = self._by_class("email", local, self._permute)
        return None if new is None else f"{new}@{domain}"

    def _token(self, m: re.Match) -> str | None:
        """A key with a known prefix, which stays, or a secret with small and capital letters and digits."""
        prefix = m[1] or m[2] or ""
        if not prefix and not all(re.search(c, m[0]) for c in ("[a-z]", "[A-Z]", "[0-9]")):
            return None
        if m[2] and not re.search("[0-9]", m[0][len(prefix) :]):
            return None

        def once(kind: str, size: int, x: int) -> int:  # hardly any two have one form: no network is kept
            network = Feistel(self.key, kind, size)
            return network.decrypt(x) if self.inverse else network.encrypt(x)

        new = self._by_class("token", m[0][len(prefix) :], once)
        return None if new is None else prefix + new

    @staticmethod
    def _by_class(kind: str, text: str, permute: Callable[[str, int, int], int]) -> str | None:
        bases = [(26, "a") if c.islower() and c.isascii() else (26, "A") if c.isupper() and c.isascii() else (10, "0") if c.isascii() and c.isdigit() else None for c in text]
        size = x = 0
        for base, c in zip(bases, text):
            if base:
                size, x = (size or 1) * base[0], x * base[0] + ord(c) - ord(base[1])
        if not size:
            return None
        form = "".join(b[1] if b else c for b, c in zip(bases, text))
        x = permute(f"{kind} {form}", size, x)
        out = list(text)
        for k in reversed(range(len(text))):
            if bases[k]:
                x, d = divmod(x, bases[k][0])
                out[k] = chr(ord(bases[k][1]) + d)
        return "".join(out)

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The new text, and (kind, begin, end) of what was replaced. Where forms overlap, the kind listed first wins."""
        taken: list[tuple[int, int, str, str]] = []
        digits = bool(_DIGIT.search(text))
        for kind, pattern, new in self.kinds:
            if not (("@" in text) if kind == "email" else _YEAR.search(text) if kind == "named date" else digits or kind in ("token", "password")):
                continue
            for m in pattern.finditer(text):
                if any(a < m.end() and m.start() < b for a, b, *_ in taken):
                    continue
                value = new(m)
                if value is not None:
                    taken.append((m.start(), m.end(), kind, value))
        if not taken:
            return text, []
        out, at = [], 0
        for a, b, _, value in sorted(taken):
            out += [text[at:a], value]
            at = b
        return "".join([*out, text[at:]]), [(kind, a, b) for a, b, kind, _ in sorted(taken)]


_YEAR = re.compile(r"(?:19|20)\d\d")
_DIGIT = re.compile(r"[0-9]|[0-9a-fA-F]{32}")


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", inverse: bool = False) -> DataFrame:
    """``docs`` with its text column replaced, and the number of replacements in a new column n_replaced (or a fresh name)."""
    count = fresh(docs, "n_replaced")
    fields = [StructField(f.name, StringType()) if f.name == text else f for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replace = Pseudonyms(key, inverse).replace
        for batch in batches:
            done = [(None, []) if t is None else replace(t) for t in batch.column(text).to_pylist()]
            columns = dict(zip(batch.schema.names, batch.columns)) | {text: pa.array([t for t, _ in done], pa.string())}
            columns[count] = pa.array([len(found) for _, found in done], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, relaxed(StructType([*fields, StructField(count, LongType())])))
