"""Personal data in text: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.components import prepare

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]

# Base kinds. E-mail and address patterns are cut so that each character is visited a bounded number of
# times; find_base puts the parts together as the plain patterns would.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SEPARATORS = str.maketrans("", "", " -.()+")
# Added kinds.
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}))")
_WORD_END = re.compile(r"(?<=[A-Z0-9])(?![A-Za-z0-9])")
#: Characters of an account number by its country.
_LENGTHS = {
    country: int(length)
    for length, countries in (
        line.split(":")
        for line in "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
        "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
        "28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU".split()
    )
    for country in countries.split(",")
}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
#: Words whose presence within CONTEXT characters before a span speaks for its kind.
WORDS = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "server", "host"),
    "card": ("card", "visa", "payment", "credit"),
    "phone": ("phone", "tel", "call", "fax", "mobile"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security"),
}
CONTEXT = 40
#: What a kind scores by its form and checksum alone, what a nearby word adds, and what an added kind must reach.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
WORD_SCORE = 0.3
THRESHOLD = 0.5


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number holds."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether the check digits of an international account number hold."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        end = at + 1
        if start < at and (m := _AT.match(text, at)):
            end = done = m.end()
            yield start, end
        at = text.find("@", end)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for chain in _DOTTED.finditer(text):
        if chain[0].count(".") < 3:
            continue
        parts = list(_PART.finditer(text, *chain.span()))
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            if all(len(p[0].lstrip("0")) <= 3 and int(p[0].lstrip("0") or 0) <= 255 for p in four):
                yield four[0].start(), four[3].end()


def find_base(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, each kind leftmost and non-overlapping; failing matches are dropped."""
    found = [("email", s, e) for s, e in _emails(text)]
    found += [("ip", s, e) for s, e in _addresses(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].translate(_SEPARATORS)
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(m[0].translate(_SEPARATORS)) <= 15:
            found.append(("phone", *m.span()))
    return found


def _accounts(text: str) -> Iterator[tuple[int, int]]:
    """From each start the span to the end of a word that passes the checksum: one of its country's length, or else the
    longest. Without one the search goes on behind the start, which has read 64 characters at most."""
    m = _IBAN.search(text)
    while m:
        start, at = m.start(), m.end()
        ends = [e.end() for e in _WORD_END.finditer(text, at, min(len(text), m.end(1) + 1)) if e.end() <= m.end(1)]
        plain = {end: text[start:end].replace(" ", "") for end in ends}
        for end in sorted(ends, key=lambda e: (len(plain[e]) != _LENGTHS.get(m[0][:2]), -e)):
            if len(plain[end]) >= 15 and mod97(plain[end]):
                yield start, end
                at = end
                break
        m = _IBAN.search(text, at)


def find_added(text: str) -> list[tuple[str, int, int]]:
    found = [("iban", *span) for span in _accounts(text)]
    found += [("ssn", *m.span()) for m in _SSN.finditer(text)]
    return found


def score(text: str, kind: str, start: int) -> float:
    before = text[max(0, start - CONTEXT) : start].lower()
    near = any(re.search(rf"(?<![a-z]){w}", before) for w in WORDS[kind])
    return min(1.0, SCORES[kind] + WORD_SCORE * near)


def find(text: str | None) -> list[dict]:
    """All spans of a text in the order of their start, then kind: base ones whatever their score, added
    ones that reach THRESHOLD."""
    if not text:
        return []
    spans = [(s, KINDS.index(k), e, score(text, k, s)) for k, s, e in find_base(text)]
    for k, s, e in find_added(text):
        points = score(text, k, s)
        if points >= THRESHOLD:
            spans.append((s, KINDS.index(k), e, points))
    return [{"kind": KINDS[k], "start": s, "end": e, "score": p} for s, k, e, p in sorted(spans)]


SPANS = "array<struct<kind: string, start: bigint, end: bigint, score: double>>"


def personal_data(docs: DataFrame, text_column: str = "text", out: str = "spans") -> DataFrame:
    """The rows with their spans of personal data; offsets are code points, the end exclusive.

    A null or empty text has an empty list. Texts are read whole, row by row; every pattern takes time
    linear in the text. Repeated rows stay; a column named like ``out`` is replaced.
    """

    prepare(docs.sparkSession)

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(find)

    return docs.withColumn(out, spans(docs[text_column].cast("string")))


def redact(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows with every found span replaced by its kind in angle brackets; null stays null.

    Of overlapping spans the one that starts first is named and the whole overlap is replaced.
    """

    prepare(docs.sparkSession)

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        def clean(text):
            if text is None:
                return None
            parts, at = [], 0
            for span in find(text):
                if span["start"] >= at:
                    parts += [text[at : span["start"]], f"<{span['kind']}>"]
                at = max(at, span["end"])
            return "".join([*parts, text[at:]])

        return texts.map(clean)

    return docs.withColumn(text_column, cleaned(docs[text_column].cast("string")))
