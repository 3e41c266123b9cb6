"""Secret scan: Aho-Corasick keywords, anchored regular expressions at their hits, then embedded checksums.

One pass over each text. A single automaton finds every keyword; only there does the regular expression of the
keyword's kind run, anchored at the hit. Kinds whose format embeds a checksum are reported only if it holds, which
separates real credentials from look-alikes. `hex` runs have no keyword, so one linear scan finds them.

Account and card numbers may begin up to `NEAR` characters after a keyword or after another number that was found.
Every group of digits or letters there is tried as a beginning, at each length that its country or issuer allows and
that ends with a group, so what stands before or behind a number doesn't hide it.

Time is linear in the length of a text, however long: no place is tried twice for a kind.

Defined results: a null text counts as empty; an empty text has no spans. Repeated rows each get their own result,
rows with a null doc_id too. Spans of different kinds may overlap; ties are listed by kind. Input columns other than
doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
from pyspark.sql import DataFrame

from quern.llm.common import map_texts

BASE_KINDS = ("assign", "access", "hex")
#: Kinds that the method adds to the base ones, in the order in which ties are listed.
CHECKED_KINDS = ("github", "npm", "iban", "card")
KINDS = BASE_KINDS + CHECKED_KINDS

# Keywords (lower case), the kind each one leads to.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "api_key": "assign", "apikey": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
    "iban": "iban",
    "card": "card", "visa": "card", "mastercard": "card",
}

# Applied to the text with A-Z in lower case, so that letters of the name may be in either case and nothing else.
ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CREDENTIAL = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NEAR = 32  # characters between a keyword, or a number that was found, and the next number
IBAN_START = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}")
CARD_START = re.compile(r"(?<![0-9])[0-9]")
DIGITS = re.compile(r"[0-9]+(?:[ -][0-9]+)*")

# Characters of an account number by country (the public registry of ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
    "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
# First digits of an issuer's cards, the numbers of digits that its cards have, the usual one first.
CARD_ISSUERS = (
    (re.compile("4"), (16, 19, 13)),
    (re.compile("5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720"), (16,)),
    (re.compile("3[47]"), (15,)),
    (re.compile("30[0-5]|3[689]"), (14, 16, 19)),
    (re.compile("352[89]|35[3-8]"), (16, 19)),
    (re.compile("6011|64[4-9]|65"), (16, 19)),
    (re.compile("62"), (16, 17, 18, 19)),
    (re.compile("50|5[6-9]|6"), (16, 19, 18, 17, 15, 14, 13, 12)),
)
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_holds(body: str, check: str) -> bool:
    """The last six characters are the CRC-32 of those before, in base 62."""
    value = 0
    for c in check:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body.encode())


def luhn_holds(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_holds(code: str) -> bool:
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def iban_at(text: str, at: int) -> int | None:
    """The end of an account number that begins at `at`; groups may be apart by one space."""
    length = IBAN_LENGTHS.get(text[at : at + 2])
    end, left = at, length or 0
    while left and end < len(text):  # at most `length` steps of two characters
        if text[end] == " " and end > at and text[end - 1] != " ":
            end += 1
        elif text[end].isascii() and (text[end].isdigit() or text[end].isupper()):
            end, left = end + 1, left - 1
        else:
            return None
    follows = text[end : end + 1]
    if not length or left or follows.isascii() and follows.isalnum():
        return None
    return end if iban_holds(text[at:end].replace(" ", "")) else None


def card_at(text: str, at: int) -> int | None:
    """The end of a card number that begins at `at`; groups may be apart by one space or hyphen."""
    m = DIGITS.match(text, at, at + 40)  # 19 digits, each apart, and one character more
    ends = [at + i for i in range(1, m.end() - at + 1) if not text[at + i : at + i + 1].isdigit() and text[at + i - 1].isdigit()]
    by_size = {sum(c.isdigit() for c in text[at:e]): e for e in ends}
    sizes = next((sizes for first, sizes in CARD_ISSUERS if first.match(text, at)), ())
    return next((by_size[n] for n in sizes if n in by_size and luhn_holds(re.sub("[ -]", "", text[at : by_size[n]]))), None)


def ascii_lower(text: str) -> str:
    """A-Z to a-z and nothing else, so that offsets stay."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


#: For kinds of numbers: what they begin with, and a function to their end.
NUMBERS = {"iban": (IBAN_START, iban_at), "card": (CARD_START, card_at)}


class Scanner:
    def __init__(self, keywords: dict[str, str] = KEYWORDS):
        self.automaton = ahocorasick.Automaton()
        for word, kind in keywords.items():
            self.automaton.add_word(word, (len(word), kind))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) in code points, end exclusive, by start and then by kind as listed in KINDS."""
        low = ascii_lower(text)
        found = {(m.start(), m.end(), "hex") for m in HEX.finditer(text)}
        hits = sorted((end - n + 1, kind) for end, (n, kind) in self.automaton.iter(low))
        until = dict.fromkeys(KINDS, 0)  # up to here, a kind has been looked for
        for at, kind in hits:
            if kind in NUMBERS:
                start, end_of = NUMBERS[kind]
                place = max(until[kind], at + len(kind))
                limit = max(at + len(kind) + NEAR, place)
                while m := start.search(text, place, min(limit + 4, len(text))):
                    if m.start() > limit:
                        break
                    if end := end_of(text, m.start()):
                        found.add((m.start(), end, kind))
                        limit = max(limit, end + NEAR)
                    place = end or m.start() + 1
                until[kind] = max(until[kind], min(limit, len(text)))
            elif at < until[kind]:
                continue  # inside an earlier match of its kind
            elif kind == "assign" and (m := ASSIGN.match(low, at)):
                until[kind] = m.end()  # a match that is too short still takes its characters
                if m.end(1) - m.start(1) >= 6:
                    found.add((at, m.end(), kind))
            elif kind == "access" and (m := ACCESS.match(text, at)):
                until[kind] = m.end()
                if m.end() - at >= 20:
                    found.add((at, m.end(), kind))
            elif kind in ("github", "npm") and (m := CREDENTIAL.match(text, at)):
                if crc_holds(m[1], m[2]):
                    found.add((at, m.end(), kind))
        return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to doc_id, spans array<struct<kind,start,end>>: every secret of the whole text."""

    def derive():
        scanner = Scanner()
        return lambda texts: {"spans": [[{"kind": k, "start": s, "end": e} for s, e, k in scanner.spans(t)] if t else [] for t in texts]}

    return map_texts(docs, derive, "spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each span replaced by <kind>; overlapping spans are joined under the first one's kind."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def base_digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans if k in BASE_KINDS).encode()).hexdigest()
