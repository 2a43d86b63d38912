"""Personal data replaced by format-preserving pseudonyms.

A value that passes its kind's validation (check digits, number ranges, calendar) is mapped
by a keyed permutation of all values of the same format: a Feistel network
over the value's number, walked on until it hits a valid one. So the pseudonym is
as valid as the value, equal values stay linked across documents, different ones stay different,
and without the key nothing leads back.

What is permuted is the value, not its spelling: a telephone number's country and national number, a day, a card's or an IBAN's
characters without blanks, a mail address without its case. The pseudonym is then written into the layout that was
found, so ``+1 415-555-0123`` and ``(415) 555-0123``, or ``2020-01-02`` and ``2.1.2020``, stay the same value.

Kinds: card numbers (Luhn), IBANs (mod 97; unbroken or with single blanks), US social security
numbers, IPv4 addresses, telephone numbers (``+`` or ``00``, a country's code and 8 to 15 digits in any grouping, or North American
ones without the code; other national forms such as ``030 901820`` tell no country and stay), calendar dates, mail addresses, and secrets that are assigned to a name such as
``token``. A number that fails its validation is no such value and stays.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Dates are permuted among the days of these years.
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
LAST_DAY = datetime.date(2099, 12, 31).toordinal()

#: Fixed: length of an IBAN by country (ISO 13616).
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
#: Fixed: countries' telephone codes (E.164) of one and two digits; all others have three.
PHONE_CODES = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 "
    "81 82 84 86 90 91 92 93 94 95 98".split()
)

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_DIGITS = "0123456789"


class Permutation:
    """Keyed permutations of 0 .. size - 1, one for each ``tweak``."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def __call__(self, number: int, size: int, tweak: str) -> int:
        if size < 2:
            return number
        half = ((size - 1).bit_length() + 1) // 2
        mask, width = (1 << half) - 1, half // 8 + 1
        name = f"{tweak}|{size}|".encode()
        while True:
            left, right = number >> half, number & mask
            for i in range(ROUNDS):
                said = name + bytes([i]) + right.to_bytes(width, "big")
                drawn = hashlib.blake2b(said, key=self.key, digest_size=min(64, width + 8)).digest()
                # Halves of more than 64 bytes are filled by repeating the digest's hash.
                while len(drawn) < width:
                    drawn += hashlib.blake2b(drawn, key=self.key).digest()
                left, right = right, left ^ (int.from_bytes(drawn, "big") & mask)
            number = left << half | right
            if number < size:
                return number


    def within(self, number: int, size: int, tweak: str, same: Callable[[int], object]) -> int:
        """A permutation of the numbers of one class: the walk goes on until ``same`` tells what it told of ``number``."""
        wanted = same(number)
        while True:
            number = self(number, size, tweak)
            if same(number) == wanted:
                return number


def by_class(text: str, permute: Permutation, tweak: str, hexadecimal: bool = False) -> str:
    """Each digit and ASCII letter replaced by one of its class; other characters stay."""
    alphabets = []
    for c in text:
        alphabet = next((a for a in (_DIGITS, _LETTERS, _LETTERS.upper()) if c in a), "")
        if hexadecimal and alphabet:
            alphabet = _DIGITS + ("ABCDEF" if text.upper() == text else "abcdef")
        alphabets.append(alphabet)
    number, size = 0, 1
    for c, alphabet in zip(text, alphabets, strict=True):
        if alphabet:
            number, size = number * len(alphabet) + alphabet.index(c), size * len(alphabet)
    number = permute(number, size, tweak)
    out = []
    for c, alphabet in zip(reversed(text), reversed(alphabets), strict=True):
        if alphabet:
            number, k = divmod(number, len(alphabet))
            c = alphabet[k]
        out.append(c)
    return "".join(reversed(out))


def folded(text: str) -> str:
    """A-Z in lower case; other characters, and so all lengths, stay."""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def _in_case(shape: str, text: str) -> str:
    """``text`` with the capitals of ``shape``, of the same length."""
    return "".join(c.upper() if "A" <= s <= "Z" else c for s, c in zip(shape, text, strict=True))


def luhn_sum(digits: str) -> int:
    """The weighted sum; a valid number's is a multiple of ten."""
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced, in order."""
    rest = iter(digits)
    return "".join(next(rest) if c in _DIGITS else c for c in shape)


def card(text: str, permute: Permutation) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or luhn_sum(digits) % 10 or len(set(digits)) == 1:
        return None
    body = f"{permute(int(digits[:-1]), 10 ** (len(digits) - 1), 'card'):0{len(digits) - 1}d}"
    return _refill(text, body + str(-luhn_sum(body + "0") % 10))


def _mod97(country: str, bban: str) -> int:
    return int("".join(str(int(c, 36)) for c in bban + country + "00")) % 97


def iban(text: str, permute: Permutation) -> str | None:
    """The pseudonym of the IBAN that ``text`` begins with: an unbroken one, or one of its country's length."""
    ends = [m.start() for m in re.finditer(r"(?= |\Z)", text)]
    for end in ends:
        whole = text[:end].replace(" ", "")
        if end != ends[0] and len(whole) != IBAN_LENGTHS.get(whole[:2]):
            continue
        country, check, bban = whole[:2], whole[2:4], whole[4:]
        if len(bban) < 11 or int(check) != 98 - _mod97(country, bban):
            continue
        bban = by_class(bban, permute, f"iban{country}")
        rest = iter(f"{country}{98 - _mod97(country, bban):02d}{bban}")
        return "".join(c if c == " " else next(rest) for c in text[:end])
    return None


def social(text: str, permute: Permutation) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    area -= 1 + (area > 666)
    number = permute((area * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "social")
    area, rest = divmod(number, 99 * 9999)
    area += 1 + (area >= 665)
    return f"{area:03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}"


def address(text: str, permute: Permutation) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    number = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "address")
    return ".".join(map(str, number.to_bytes(4, "big")))


def national(digits: str, plus: bool) -> tuple[str, str, str] | None:
    """Country's code, trunk digit and national number of a telephone number's digits; None if it is none.

    North American numbers have ten digits. Elsewhere a 0 after the country's code is the trunk digit, which only
    some write; in Italy it belongs to the number.
    """
    if not plus:
        return ("1", "", digits) if len(digits) == 10 else None
    code = next((digits[:k] for k in (1, 2) if digits[:k] in PHONE_CODES), digits[:3])
    rest = digits[len(code) :]
    if code == "1":
        return (code, "", rest) if len(rest) == 10 else None
    trunk = "0" if code not in ("1", "39") and rest[:1] == "0" and len(rest) > 1 else ""
    return code, trunk, rest[len(trunk) :]


def phone(text: str, permute: Permutation) -> str | None:
    """The country's code and a trunk digit stay; the national number is permuted whatever its grouping.

    Numbers that begin as a North American area and exchange must, or elsewhere without a 0, go to such numbers, others to others.
    """
    text = re.sub(r"\D*\Z", "", text)
    digits = re.sub(r"\D", "", text)
    prefix = "00" if text[:2] == "00" else ""
    digits = digits[len(prefix) :]
    if not (8 if text[:1] == "+" or prefix else 10) <= len(digits) <= 15 or ((text[:1] == "+" or prefix) and digits[0] == "0"):
        return None
    parts = national(digits, text[:1] == "+" or bool(prefix))
    if parts is None or (prefix and parts[0] not in PHONE_CODES):
        return None
    code, trunk, rest = parts
    if re.fullmatch(r"\+\d+\.\d+", text) and text[1:].partition(".")[0] != code:
        return None  # a decimal fraction
    n = len(rest)

    def begins(number: int) -> object:
        said = f"{number:0{n}d}"
        return bool(re.match(r"[2-9]\d\d[2-9]", said)) if code == "1" else said[:1] == "0"

    new = permute.within(int(rest or "0"), 10**n, f"phone{code}", begins)
    return _refill(text, f"{prefix}{code}{trunk}{new:0{n}d}" if text[:1] == "+" or prefix else f"{new:0{n}d}")


def _day(year: str, month: str, day: str) -> int | None:
    try:
        n = datetime.date(int(year), int(month), int(day)).toordinal()
    except ValueError:
        return None
    return n if FIRST_DAY <= n <= LAST_DAY else None


def date(text: str, permute: Permutation) -> str | None:
    """Year first, day first, or, where that is no date, month first; one day has one pseudonym in every layout.

    Days after the twelfth go to such days, so that a date with the month first is still read so.
    """
    a, mark, b, _, c = re.split(r"([-/.])", text)
    if len(a) == 4:
        order, day = "ymd", _day(a, b, c)
    else:
        order, day = "dmy", _day(c, b, a)
        if day is None:
            order, day = "mdy", _day(c, a, b)
    if day is None:
        return None
    late = lambda k: datetime.date.fromordinal(FIRST_DAY + k).day > 12
    new = datetime.date.fromordinal(FIRST_DAY + permute.within(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date", late))
    width = 2 if all(len(x) > 1 for x in (a, b, c)) else 1
    parts = {"y": f"{new.year:04d}", "m": f"{new.month:0{width}d}", "d": f"{new.day:0{width}d}"}
    return mark.join(parts[o] for o in order)


def mail(text: str, permute: Permutation) -> str | None:
    """Both the name and the host's labels but the last are permuted, capitals stay where they are; equal hosts stay equal."""
    name, _, host = text.rpartition("@")
    labels = folded(host).split(".")
    new = ".".join([by_class(".".join(labels[:-1]), permute, "host"), labels[-1]])
    return f"{_in_case(name, by_class(folded(name), permute, 'mail' + new))}@{_in_case(host, new)}"


def secret(text: str, permute: Permutation) -> str | None:
    return by_class(text, permute, "secret", bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text)))


#: What may stand between two digits of a telephone number.
_BETWEEN = r"\)?(?: [-/] |[ \u00a0\u202f./-])?\(?"
#: Kinds whose pattern can run on behind the value; the pseudonym has the value's length.
_RUN_ON = frozenset(("iban", "phone"))

#: In this order; a value is taken by the first kind that accepts it.
KINDS: dict[str, tuple[re.Pattern, Callable[[str, Permutation], str | None]]] = {
    "secret": (
        re.compile(
            r"(?i:\b(?:token|secret|passwd|password|api[_-]?key|access[_-]?key)\b\W{0,4}[=:]\s*[\"']?)"
            r"([A-Za-z0-9_+/-]{16,})"
        ),
        secret,
    ),
    "mail": (re.compile(r"(?<![\w.+-])([\w.+-]*\w@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})(?![\w-])"), mail),
    "iban": (re.compile(r"\b(?=([A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}\b))"), iban),
    "social": (re.compile(r"(?<![\w.-])(\d{3}-\d{2}-\d{4})(?![\w-])"), social),
    "date": (
        re.compile(r"(?<![\w.,/-])(\d{4}([-/.])\d{1,2}\2\d{1,2}|\d{1,2}([-/.])\d{1,2}\3\d{4})(?![\w/-]|[.,]\d)"),
        date,
    ),
    "address": (re.compile(r"(?<![\w.])(\d{1,3}(?:\.\d{1,3}){3})(?!\w|\.\d)"), address),
    "phone": (
        re.compile(
            rf"(?<![\w.+-])(\+1(?:{_BETWEEN}\d){{10}}|\+\d(?:{_BETWEEN}\d){{7,14}}|(?<!\d )00[1-9](?:{_BETWEEN}\d){{7,14}}"
            r"|(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4})(?![\w-])"
        ),
        phone,
    ),
    "card": (
        re.compile(
            r"(?<![\w.-])(\d{13,19}|\d{4}([ -])\d{4}\2\d{4}\2\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-]|\.\d)"
        ),
        card,
    ),
}


def pseudonymise(text: str, permute: Permutation) -> tuple[str, list[str]]:
    """The text with its values replaced, and the kind of each of them by place."""
    taken: list[tuple[int, int, str, str]] = []  # by place, apart from one another
    for kind, (pattern, replace) in KINDS.items():
        for m in pattern.finditer(text):
            start, end = m.span(1)
            at = bisect.bisect(taken, (start,))
            if at and taken[at - 1][1] > start:
                continue
            if at < len(taken) and taken[at][0] < end:
                if kind not in _RUN_ON or taken[at][0] == start:
                    continue
                end = taken[at][0]
            if (new := replace(text[start:end], permute)) is not None:
                end = start + len(new) if kind in _RUN_ON else end
                taken.insert(at, (start, end, kind, new))
    out, at = [], 0
    for start, end, _, new in taken:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), [kind for _, _, kind, _ in taken]


def _replacer(key: bytes) -> Callable:
    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permute = Permutation(key)
        for batch in batches:
            texts = batch.column(1)
            # Every kind but secrets needs a digit or an at sign; secrets need a name's mark.
            some = pc.fill_null(pc.match_substring_regex(texts, r"[0-9@]|[=:]\s*[\"']?[A-Za-z0-9_+/-]{16}"), False)
            new, kinds = texts.to_pylist(), [[]] * len(texts)
            for i in pc.indices_nonzero(some).to_pylist():
                new[i], kinds[i] = pseudonymise(new[i], permute)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(new, type=pa.string()),
                    pa.array([len(k) for k in kinds], type=pa.int64()),
                    pa.array([sorted(set(k)) for k in kinds], type=pa.list_(pa.string())),
                ],
                names=["id", "text", "n_replaced", "kinds"],
            )

    return replace


def pseudonymised(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id>, text, n_replaced, kinds of every row of ``docs``, without a shuffle.

    ``key`` is the secret that links the pseudonyms; the same key gives the same ones in every
    run. A null text stays null, texts without a value stay as they are, ids pass through, repeated
    and null ones, too. An empty table gives an empty result; a text of any length is read whole. Of overlapping values the first kind in KINDS wins. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
        .mapInArrow(_replacer(key), f"id {kind}, text string, n_replaced bigint, kinds array<string>")
        .withColumnRenamed("id", id_col)
    )
