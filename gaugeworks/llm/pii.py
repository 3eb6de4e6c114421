"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Four base kinds (email, ip, card, phone) are always reported where their pattern and validator hold. Further kinds are
reported if their score, which context words raise, reaches a threshold.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import map_batches, texts

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "national_id", "birth_date")

# Prior score of a span that its validator confirms, and the words that raise it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "national_id": 0.3, "birth_date": 0.2}
CONTEXT = {
    "email": ("email", "mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "national_id": ("ssn", "social", "security", "passport", "identity"),
    "birth_date": ("born", "birth", "birthday", "dob", "geboren", "nacido", "né"),
}
CONTEXT_BONUS, CONTEXT_CHARS, THRESHOLD = 0.4, 40, 0.5

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# The look-behind skips starts inside a run of digits, where the pattern fails as it did at the start of the run.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
BIRTH_DATE = re.compile(r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9])")
# Characters of an IBAN by country.
IBAN_SIZES = {
    entry[:2]: int(entry[2:])
    for entry in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 "
        "FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 "
        "LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 "
        "SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
NOT_DIGIT = re.compile(r"[^0-9]")
WORD_CHAR = re.compile(r"[A-Za-z0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (2 if place % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def mod97(text: str) -> bool:
    compact = text.replace(" ", "")
    moved = compact[4:] + compact[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def ibans(text: str):
    """Spans that mod 97 confirms, of the length of their country; other countries' may end with any word, the last first.

    What follows an IBAN, such as a BIC or another IBAN, is not taken into it.
    """
    at = 0
    while found := IBAN_START.search(text, at):
        start, at = found.start(), found.end()
        whole = IBAN.match(text, start)
        if not whole:
            continue
        ends = [i for i in range(start + 1, whole.end() + 1) if text[i - 1] != " "]
        size = IBAN_SIZES.get(text[start : start + 2])
        for n in [size] if size else range(len(ends), 14, -1):
            if n <= len(ends) and not WORD_CHAR.match(text, ends[n - 1]) and mod97(text[start : ends[n - 1]]):
                at = ends[n - 1]
                yield start, at
                break


def emails(text: str):
    """Leftmost matches of local part, @ and domain: each @ is visited once, so long words without @ cost nothing."""
    taken, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            taken = found.end()
            yield start, taken
        at = text.find("@", max(at + 1, taken))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if not any(d in text for d in "0123456789"):
        return spans
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def calendar_day(date: str) -> bool:
    """Whether a date has a month and a day, in either order where the year comes last, and a year of 1800 or later."""
    numbers = [int(n) for n in re.split("[-./]", date)]
    year, parts = (numbers[0], numbers[1:]) if "-" in date else (numbers[2], numbers[:2])
    month, day = parts if "-" in date else sorted(parts)
    return year >= 1800 and 1 <= month <= 12 and 1 <= day <= 31


def added_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("iban", *span) for span in ibans(text)]
    for m in NATIONAL_ID.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            spans.append(("national_id", *m.span()))
    spans += [("birth_date", *m.span()) for m in BIRTH_DATE.finditer(text) if calendar_day(m[0])]
    return spans


def score(text: str, kind: str, start: int, end: int) -> float:
    near = re.findall(r"\w+", (text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]).lower())
    return round(min(1.0, PRIOR[kind] + CONTEXT_BONUS * any(w in near for w in CONTEXT[kind])), 4)


def find_in_text(text: str, threshold: float = THRESHOLD) -> list[dict]:
    """All spans of a text by kind, then start. Positions are code points, the end is exclusive."""
    found = [dict(kind=k, start=s, end=e, score=score(text, k, s, e)) for k, s, e in base_spans(text)]
    if any(d in text for d in "0123456789"):
        more = [dict(kind=k, start=s, end=e, score=score(text, k, s, e)) for k, s, e in added_spans(text)]
        found += [span for span in more if span["score"] >= threshold]
    return found


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, spans: one row per input row, in one pass and without a shuffle.

    A null text has no spans. Repeated rows are searched each on its own; an empty table gives an empty result.
    """

    def search(ids, bodies):
        return ids, [find_in_text(body, threshold) for body in bodies]

    return map_batches(texts(docs, id_col, text_col), search, f"doc_id long, spans {SPANS}")


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
