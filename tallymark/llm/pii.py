"""PII: format-preserving pseudonyms from a keyed Feistel permutation.

Each kind of value has a finite domain of valid values: card numbers by their free digits (the check digit follows), dates by
their day, and so on. A value is validated, turned into its number in the domain, permuted, and written back in the format it
was found in. The permutation is an eight-round Feistel network on an even number of bits with HMAC-SHA256 as round function,
walked until it lands in the domain again; between it and its inverse stands a keyed shift, so no value is left as it is. It
depends on the key and the kind only, so equal values stay linked across documents, and different values stay different. Values
that fail validation are left as they are, and so are the domains of e-mail addresses. The search is linear in a text's length.
"""

from __future__ import annotations

import datetime
import hmac
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm._shared import session

ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: Lengths of IBANs by country.
IBAN = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
_FOUND = re.compile(
    r"(?<![A-Za-z0-9._%+-])[._%+-]*+(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|key)\b)[\"']?\s*[=:]\s*[\"']?(?P<secret>[A-Za-z0-9_+/-]{16,})"
    r"|(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])"
    r"|(?<![\w.])(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?![\w]|\.\d)"
    r"|(?<![\w])(?P<iso>\d{4}-\d{2}-\d{2})(?![\d-]|\w)"
    r"|(?<![\w./-])(?P<day>\d{1,2}(?P<mark>[./-])\d{1,2}(?P=mark)(?:19|20)\d{2})(?![\w]|[./-]\d)"
    r"|(?<![\w+])(?P<phone>\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+\d{1,3}[ -]?(?:\(\d{1,4}\)|\d{1,4})(?:[ -]?\d{2,4}){2,4}(?![.-]?\d))"
    r"|(?<![\w+(.-])(?P<national>(?:\(\d{3}\)[ .-]?|\d{3}(?P<dash>[.-]))\d{3}(?(dash)(?P=dash)|[ .-])\d{4})(?![\w-]|\.\d)"
    r"|(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<![\w.])(?P<card>\d(?:[ -]?\d){12,18})(?!\w)"
)
_KINDS = tuple(k for k in _FOUND.groupindex if k not in ("mark", "dash"))
_RADIX = {**{c: (10, 48) for c in "0123456789"}, **{chr(c): (26, 97) for c in range(97, 123)}, **{chr(c): (26, 65) for c in range(65, 91)}}


class Feistel:
    """A keyed permutation of range(size) for any size, one for each kind, that leaves no value in its place (but where there is one only)."""

    def __init__(self, key: bytes) -> None:
        self.key = key

    def _bits(self, message: bytes, width: int) -> int:
        digest, more = b"", 0
        while len(digest) < width:
            digest += hmac.digest(self.key, message + bytes([more]), "sha256")
            more += 1
        return int.from_bytes(digest[:width], "big")

    def _network(self, value: int, size: int, kind: str, rounds: range) -> int:
        """The rounds in their order or from the last to the first, which undoes them."""
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask, width = (1 << half) - 1, (half + 7) // 8
        swap = rounds.step < 0
        while True:
            left, right = value >> half, value & mask
            for i in rounds:
                if swap:
                    left, right = right, left
                left, right = right, left ^ (self._bits(f"{kind}/{size}/{i}/".encode() + right.to_bytes(width, "big"), width) & mask)
                if swap:
                    left, right = right, left
            value = left << half | right
            if value < size:
                return value

    def __call__(self, value: int, size: int, kind: str, back: bool = False) -> int:
        """back: what the permutation takes to value."""
        if size < 2:
            return value
        shift = 1 + self._bits(f"{kind}/{size}/shift/".encode(), 16) % (size - 1)
        mixed = (self._network(value, size, kind, range(ROUNDS)) + (-shift if back else shift)) % size
        return self._network(mixed, size, kind, range(ROUNDS - 1, -1, -1))


def luhn(digits: str) -> int:
    """The digit that completes digits to a valid card number."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _mod97(country: str, bban: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in bban + country + "00")) % 97


def _refill(shape: str, values: str) -> str:
    """The shape's letters and digits replaced by values in order; all else stays."""
    it = iter(values)
    return "".join(next(it) if c.isalnum() else c for c in shape)


class Pseudonyms:
    """Replaces what is found and valid. Each method returns the new value, or None for an invalid one."""

    def __init__(self, key: bytes) -> None:
        self.permute = Feistel(key)

    def _letters(self, kind: str, text: str) -> str:
        """Each digit to a digit, each letter to a letter of its case, as one number in mixed radix."""
        number, size, kinds = 0, 1, [_RADIX.get(c) for c in text]
        for c, k in zip(text, kinds, strict=True):
            if k:
                number, size = number * k[0] + ord(c) - k[1], size * k[0]
        shape = "".join("x" if k is None else {48: "0", 97: "a", 65: "A"}[k[1]] for k in kinds)
        number = self.permute(number, size, f"{kind}:{shape}")
        out = []
        for c, k in zip(reversed(text), reversed(kinds), strict=True):
            if k:
                number, digit = divmod(number, k[0])
                c = chr(k[1] + digit)
            out.append(c)
        return "".join(reversed(out))

    def email(self, found: str) -> str:
        local, _, domain = found.partition("@")
        return f"{self._letters('email', local)}@{domain}"

    def secret(self, found: str) -> str | None:
        if not any(c.isdigit() for c in found) or not any(c.isalpha() for c in found):
            return None
        if re.fullmatch("[0-9a-f]+|[0-9A-F]+", found):
            out = f"{self.permute(int(found, 16), 16 ** len(found), f'hex:{len(found)}'):0{len(found)}x}"
            return out if found == found.lower() else out.upper()
        return self._letters("secret", found)

    def iban(self, found: str) -> str | None:
        plain = found.replace(" ", "")
        country, bban = plain[:2], plain[4:]
        if IBAN.get(country) != len(plain) or f"{_mod97(country, bban):02d}" != plain[2:4]:
            return None
        bban = self._letters(f"iban:{country}", bban)
        return _refill(found, f"{country}{_mod97(country, bban):02d}{bban}")

    def ip(self, found: str) -> str | None:
        parts = [int(x) for x in found.split(".")]
        if max(parts) > 255:
            return None
        number = self.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
        return ".".join(map(str, number.to_bytes(4, "big")))

    def _date(self, year: int, month: int, day: int) -> datetime.date | None:
        try:
            number = datetime.date(year, month, day).toordinal() - FIRST_DAY
        except ValueError:
            return None
        if not 0 <= number <= LAST_DAY - FIRST_DAY:
            return None
        return datetime.date.fromordinal(FIRST_DAY + self.permute(number, LAST_DAY - FIRST_DAY + 1, "date"))

    def iso(self, found: str) -> str | None:
        date = self._date(*map(int, found.split("-")))
        return date and date.isoformat()

    def day(self, found: str) -> str | None:
        mark = re.search(r"\D", found)[0]
        a, b, year = map(int, found.split(mark))
        day_first = mark != "/" or a > 12
        date = self._date(year, b, a) if day_first else self._date(year, a, b)
        if date is None:
            return None
        a, b = (date.day, date.month) if day_first else (date.month, date.day)
        wide = 2 if found[0] == "0" or found.split(mark)[1][0] == "0" or len(found) == 10 else 1
        return f"{a:0{wide}d}{mark}{b:0{wide}d}{mark}{date.year}"

    def phone(self, found: str) -> str | None:
        country = re.match(r"\+\d{1,3}?(?=\D)|\+\d{1,2}", found)[0]
        rest = found[len(country) :]
        digits = re.sub(r"\D", "", rest)
        if not 7 <= len(digits) <= 13:
            return None
        number = self.permute(int(digits), 10 ** len(digits), f"phone:{len(digits)}")
        return country + _refill(rest, f"{number:0{len(digits)}d}")

    def national(self, found: str) -> str | None:
        """Ten digits without a country's; an area doesn't start with 0 or 1."""
        digits = re.sub(r"\D", "", found)
        if digits[0] in "01":
            return None
        while True:
            digits = f"{self.permute(int(digits), 10**10, 'national'):010d}"
            if digits[0] not in "01":
                return _refill(found, digits)

    def ssn(self, found: str) -> str | None:
        if not self._issued(digits := found.replace("-", "")):
            return None
        while True:
            digits = f"{self.permute(int(digits), 10**9, 'ssn'):09d}"
            if self._issued(digits):
                return _refill(found, digits)

    @staticmethod
    def _issued(digits: str) -> bool:
        return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"

    def card(self, found: str) -> str | None:
        digits = re.sub(r"\D", "", found)
        if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) < 2:
            return None
        body = f"{self.permute(int(digits[:-1]), 10 ** (len(digits) - 1), f'card:{len(digits)}'):0{len(digits) - 1}d}"
        return _refill(found, f"{body}{luhn(body)}")

    @staticmethod
    def _parts(kind: str, found: str) -> Iterator[str]:
        """All of what is found, then what ends before a separator in it: other groups may follow a card or an IBAN."""
        yield found
        if kind == "card":
            for m in reversed([*re.finditer("[ -]", found)]):
                if sum(map(str.isdigit, found[: m.start()])) >= 13:
                    yield found[: m.start()]
        elif kind == "iban" and (n := IBAN.get(found[:2])):
            if m := re.match(rf"(?: ?[A-Z0-9]){{{n}}}(?= )", found):
                yield m[0]

    def rewrite(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with its valid values replaced, and how many of each kind."""
        counts: dict[str, int] = {}
        out: list[str] = []
        done = at = 0
        while m := _FOUND.search(text, at):
            kind = next(k for k in _KINDS if m[k] is not None)
            method: Callable[[str], str | None] = getattr(self, kind)
            part, new = next(((part, new) for part in self._parts(kind, m[kind]) if (new := method(part)) is not None), ("", None))
            if new is None:  # what is not valid may still hold or precede something that is
                at = m.start() + 1
                continue
            counts[kind] = counts.get(kind, 0) + 1
            out += (text[done : m.start(kind)], new)
            done = at = m.start(kind) + len(part)
        return "".join([*out, text[done:]]), counts


def _rewrite(key: bytes):
    names = ["doc_id", "text", "n_found", "n_numbers", "n_dates", "n_names", "kinds"]
    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pseudonyms = Pseudonyms(key)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new, counts = (None, {}) if text is None else pseudonyms.rewrite(text)
                dates, names_ = counts.get("iso", 0) + counts.get("day", 0), counts.get("email", 0) + counts.get("secret", 0)
                n = sum(counts.values())
                out.append((doc_id, new, n, n - dates - names_, dates, names_, ",".join(sorted(counts))))
            cols = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """One row per row of docs: doc_id, text, n_found (of any kind), n_numbers, n_dates, n_names (e-mail local parts and secrets), kinds.

    Reads doc_id and text; other columns are ignored. A null text stays null, an empty one empty. A very long text is read once from
    its start to its end. Rows that repeat an id are rewritten each for itself. Nothing is shuffled. An empty table gives no rows.
    """
    session(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_rewrite(key), "doc_id long, text string, n_found long, n_numbers long, n_dates long, n_names long, kinds string")


def rewritten_rows(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with the new text in place of the old, all other columns as they are; n_chars, if there, follows the text."""
    session(docs)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pseudonyms, at = Pseudonyms(key), names.index("text")
        for batch in batches:
            texts = [t if t is None else pseudonyms.rewrite(t)[0] for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, names[at], pa.array(texts, pa.string()))

    out = docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
