"""Format-preserving pseudonyms for personal data.

Every finding is validated (Luhn, mod 97, number plan, octets, calendar), read as a number of a known domain, sent
through a keyed Feistel permutation of that domain and written back in its format. Equal values get equal
pseudonyms in every document and whatever their separators; different values never share one. Pseudonyms pass the
same validation, and :func:`reveal` takes them back with the key.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8


def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """Keyed permutation of ``range(size)``: a Feistel network on the next square, walked until it lands inside."""
    side = isqrt(size - 1) + 1 if size > 1 else 1
    rounds = range(ROUNDS)

    def noise(i: int, half: int) -> int:
        data = f"{tweak}|{size}|{i}|{half}".encode()
        return int.from_bytes(blake2b(data, key=key, digest_size=16).digest(), "big")

    while True:
        left, right = divmod(value, side)
        for i in reversed(rounds) if back else rounds:
            left, right = ((right - noise(i, left)) % side, left) if back else (right, (left + noise(i, right)) % side)
        value = left * side + right
        if value < size:
            return value


# --- fixed values: what each kind of personal data looks like
PATTERNS = {
    "email": r"(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "date": r"(?<![\w.])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])",
    "ipv4": r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "card": r"(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![\w.-])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "phone_intl": r"(?<![\w.])\+[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,5}\)?){2,6}(?![0-9])",
}
# digits of most cards, and characters of the IBANs of a country
CARD = 16
IBAN = {country: int(length) for length, countries in {
    "15": "NO", "16": "BE", "18": "DK FI FO GL NL", "19": "MK SI", "20": "AT BA EE KZ LT LU XK", "21": "CH HR LI LV",
    "22": "BG BH CR DE GB GE IE ME RS VA", "23": "AE GI IL IQ TL", "24": "AD CZ ES MD PK RO SA SE SK TN VG", "25": "LY PT ST",
    "26": "IS TR", "27": "FR GR IT MC MR SM", "28": "AL AZ BY CY DO GT HU LB PL SV", "29": "BR EG PS QA UA", "30": "JO KW MU",
    "31": "MT SC", "32": "LC",
}.items() for country in countries.split()}
# --- end of fixed values

_ANY = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS.items()))
_MAYBE = re.compile(r"[0-9]|@|[0-9a-fA-F]{32}")
_MODERN = (dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal())
_DATE_FORMATS = {"-": ("%Y-%m-%d",), ".": ("%d.%m.%Y",), "/": ("%m/%d/%Y", "%d/%m/%Y")}


def _refill(pattern: str, symbols: str, accepts: Callable[[str], bool]) -> str:
    """``pattern`` with its accepted characters replaced by ``symbols`` in order."""
    rest = iter(symbols)
    return "".join(next(rest) if accepts(c) else c for c in pattern)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def luhn_digit(body: str) -> int:
    total = 0
    for place, c in enumerate(reversed(body)):
        d = int(c) * (2 if place % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _mod97(code: str) -> int:
    return int("".join(str(int(c, 36)) for c in code)) % 97


@dataclass(frozen=True)
class Keyed:
    """The permutation of one direction under one key."""

    key: bytes
    back: bool = False

    def number(self, value: int, size: int, tweak: str) -> int:
        return permute(value, size, self.key, tweak, self.back)

    def digits(self, digits: str, tweak: str) -> str:
        return str(self.number(int(digits), 10 ** len(digits), tweak)).zfill(len(digits))

    def symbols(self, text: str, alphabet: str, tweak: str) -> str:
        value = 0
        for c in text:
            value = value * len(alphabet) + alphabet.index(c)
        value, out = self.number(value, len(alphabet) ** len(text), tweak), ""
        for _ in text:
            value, place = divmod(value, len(alphabet))
            out = alphabet[place] + out
        return out

    # one method per kind: the pseudonym, or None if the finding is not valid

    def email(self, found: str) -> str | None:
        local, _, domain = found.partition("@")
        plain = "".join(c for c in local if c.isalnum()).lower()
        new = self.symbols(plain, "abcdefghijklmnopqrstuvwxyz0123456789", f"email@{domain.lower()}")
        return f"{_refill(local, new, str.isalnum)}@{domain}"

    def secret(self, found: str) -> str | None:
        if found.isdigit():
            return None
        new = self.symbols(found.lower(), "0123456789abcdef", "secret")
        return new.upper() if found.upper() == found else new

    def iban(self, found: str) -> str | None:
        code = found.replace(" ", "")
        if not 15 <= len(code) <= 34 or _mod97(code[4:] + code[:4]) != 1:
            return None
        account = code[4:]
        numbers, letters = _digits(account), "".join(c for c in account if c.isalpha())
        shape = re.sub("[A-Z]", "A", re.sub("[0-9]", "0", account))
        numbers = self.digits(numbers, f"iban{code[:2]}{shape}") if numbers else ""
        letters = self.symbols(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", f"iban{code[:2]}{shape}") if letters else ""
        account = _refill(_refill(account, numbers, str.isdigit), letters, str.isalpha)
        check = 98 - _mod97(f"{account}{code[:2]}00")
        return _refill(found, f"{code[:2]}{check:02d}{account}", str.isalnum)

    def date(self, found: str) -> str | None:
        mark = next(c for c in found if not c.isdigit())
        for form in _DATE_FORMATS[mark]:
            try:
                day = dt.datetime.strptime(found, form).toordinal()
            except ValueError:
                continue
            low, high = _MODERN
            if not low <= day < high:
                return None
            new = dt.date.fromordinal(low + self.number(day - low, high - low, "date"))
            return form.replace("%Y", f"{new.year:04d}").replace("%m", f"{new.month:02d}").replace("%d", f"{new.day:02d}")
        return None

    def ipv4(self, found: str) -> str | None:
        octets = [int(o) for o in found.split(".")]
        if max(octets) > 255 or any(len(o) > 1 and o[0] == "0" for o in found.split(".")):
            return None
        new = self.number(int.from_bytes(bytes(octets), "big"), 2 ** 32, "ipv4")
        return ".".join(map(str, new.to_bytes(4, "big")))

    def ssn(self, found: str) -> str | None:
        area, group, serial = (int(part) for part in found.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        area -= 1 + (area > 666)
        new = self.number((area * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn")
        rest, serial = divmod(new, 9999)
        area, group = divmod(rest, 99)
        area += 1 + (area >= 665)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"

    def card(self, found: str) -> str | None:
        digits = _digits(found)
        if luhn_digit(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
            return None
        body = digits[:-1]
        body = self.digits(body, "card")
        if len(set(body)) == 1 and luhn_digit(body) == int(body[0]):
            body = self.digits(body, "card")
        return _refill(found, f"{body}{luhn_digit(body)}", str.isdigit)

    def phone(self, found: str) -> str | None:
        digits = _digits(found)
        country, plan = digits[:-10], digits[-10:]
        if plan[0] < "2" or plan[3] < "2":
            return None
        value = ((int(plan[:3]) - 200) * 800 + int(plan[3:6]) - 200) * 10_000 + int(plan[6:])
        rest, line = divmod(self.number(value, 800 * 800 * 10_000, "phone"), 10_000)
        area, office = divmod(rest, 800)
        return _refill(found, f"{country}{area + 200}{office + 200}{line:04d}", str.isdigit)

    def phone_intl(self, found: str) -> str | None:
        digits = _digits(found)
        if not 8 <= len(digits) <= 15:
            return None
        return _refill(found, digits[:2] + self.digits(digits[2:], f"phone+{digits[:2]}"), str.isdigit)


def _ends(kind: str, text: str, start: int, end: int) -> list[int]:
    """Where a finding of text[start:end] may end: there or at a separator inside; the usual length first, then the longest."""
    if kind not in ("card", "iban", "phone_intl"):
        return [end]
    inside = [i for i in range(end - 1, start, -1) if not text[i].isalnum() and text[i - 1].isalnum()]
    ends = [end, *(i for i in inside if _EACH[kind].fullmatch(text, start, i))]
    usual = {"card": CARD, "iban": IBAN.get(text[start:start + 2])}.get(kind)
    return sorted(ends, key=lambda i: sum(map(str.isalnum, text[start:i])) != usual)


def _valid(kind: str, text: str, start: int, end: int, keyed: Keyed) -> tuple[str, int] | None:
    """The pseudonym of a finding of text[start:end] and the finding's end, or None if no reading is valid."""
    for i in _ends(kind, text, start, end):
        if (new := getattr(keyed, kind)(text[start:i])) is not None:
            return new, i
    return None


def replace_in(text: str, keyed: Keyed) -> tuple[str, list[dict]]:
    """The text with pseudonyms, and its findings: kind, start and end in the given text, pseudonym."""
    if not _MAYBE.search(text):
        return text, []
    parts, spans, at, pos = [], [], 0, 0
    while found := _ANY.search(text, pos):
        kind, start = found.lastgroup, found.start()
        done = _valid(kind, text, start, found.end(), keyed)
        if done is None:
            # not valid as this kind: another kind may begin at the same place
            for other in list(PATTERNS)[list(PATTERNS).index(kind) + 1:]:
                again = _EACH[other].match(text, start)
                if again and (done := _valid(other, text, start, again.end(), keyed)) is not None:
                    kind = other
                    break
        if done is None:
            pos = _next_start(text, start)
            continue
        new, end = done
        parts += [text[at:start], new]
        spans.append({"kind": kind, "start": start, "end": end, "pseudonym": new})
        at = pos = end
    return "".join([*parts, text[at:]]), spans


_EACH = {kind: re.compile(pattern) for kind, pattern in PATTERNS.items()}
_TOKEN_END = re.compile(r"[^0-9A-Za-z]")


def _next_start(text: str, start: int) -> int:
    """Where the next finding may begin: behind the token at ``start``."""
    end = _TOKEN_END.search(text, start + 1)
    return end.start() if end else len(text)


_SPANS = "array<struct<kind:string,start:int,end:int,pseudonym:string>>"


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", out: str = "text", spans: str = "findings") -> DataFrame:
    """``docs`` with pseudonyms in ``text`` (as column ``out``) and the list of findings.

    Rows, their number and all other columns stay as they are; a null text stays null and has no findings.
    Positions count characters of the given text.
    """
    return _mapped(docs, Keyed(key), text, out, spans)


def reveal(docs: DataFrame, key: bytes, text: str = "text", out: str = "text", spans: str = "findings") -> DataFrame:
    """The way back with the same key. Values that a text held before and that look like pseudonyms change too."""
    return _mapped(docs, Keyed(key, back=True), text, out, spans)


def _mapped(docs: DataFrame, keyed: Keyed, text: str, out: str, spans: str) -> DataFrame:
    kind = f"struct<text:string,findings:{_SPANS}>"

    @F.arrow_udf(kind)
    def replaced(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        arrow = pa.struct([("text", pa.string()), ("findings", pa.list_(pa.struct([
            ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pseudonym", pa.string())])))])
        for batch in batches:
            rows = [(None, []) if t is None else replace_in(t, keyed) for t in batch.to_pylist()]
            yield pa.array([{"text": t, "findings": f} for t, f in rows], arrow)

    done = "__pseudonyms"
    return (docs.withColumn(done, replaced(F.col(text)))
            .withColumns({out: F.col(f"{done}.text"), spans: F.col(f"{done}.findings")}).drop(done))
