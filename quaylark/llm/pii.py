"""Personal data, also where it is disguised.

A text is read by small transducers that write a plain form and keep, for each character
of it, the source characters it came from: look-alike letters and digits of other scripts
become ASCII, invisible characters go, runs of spelled digits become digits, and written
at/dot signs become @ and full stops. Identifiers are looked for in the text as it is and
in its plain form; spans of the latter are mapped back to source characters.
"""

from __future__ import annotations

import re
import unicodedata
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylark.llm.common import col, python_map

KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is taken whole, so a match can't start inside one.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = dict(zip("аАВеЕКМНоОрРсСТуУхХіІјЈѕЅԁһԝ", "aABeEKMHoOpPcCTyYxXiIjJsSdhw", strict=True)) | dict(zip("αΑΒΕΖΗΙΚΜΝοΟΡΤΥΧνκιρ", "aABEZHIKMNoOPTYXvkip", strict=True))
INVISIBLE = "­​‌‍‎‏⁠﻿"
DIGIT_WORDS = {w: str(i) for i, w in enumerate(("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"))} | {"oh": "0"}

_ODD = re.compile(f"[{''.join(LOOK_ALIKES)}{INVISIBLE}٠-٩۰-۹०-९！-～①-⑨\U0001d7ce-\U0001d7ff]")
_WORD = "(?:" + "|".join(DIGIT_WORDS) + ")"
#: A run of digits with three spelled ones at least; the words stand by themselves.
_ITEM = rf"(?:{_WORD}(?![a-z])|[0-9]+(?![a-z]))"
_SPELLED = re.compile(rf"(?<![a-z0-9])(?:plus[ ,-]+|\+[ ,-]*)?{_ITEM}(?:[ ,-]+{_ITEM}){{2,}}", re.IGNORECASE | re.ASCII)
_SPELLED_PART = re.compile(rf"({_WORD}|plus)|[0-9]+|\+", re.IGNORECASE | re.ASCII)
_GAP = re.compile(r"[ ,-]+")
_SIGN = re.compile(r"\s?[\[({<]\s?(at|dot)\s?[\])}>]\s?", re.IGNORECASE | re.ASCII)
_SAID = re.compile(r"(?<=[A-Za-z0-9_%+-]) at (?=[A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{1,63})+)", re.IGNORECASE | re.ASCII)
_SPACED = re.compile(r"(?<=[A-Za-z0-9_%+-]) ?@ ?(?=[A-Za-z0-9-]{1,63}(?:(?: \. |\.)[A-Za-z0-9-]{1,63})+)")
_SPACED_TAIL = re.compile(r"[A-Za-z0-9-]+(?:(?: \. |\.)[A-Za-z0-9-]+)+")
_SAID_DOT = re.compile(r"(?<=[A-Za-z0-9-]) dot (?=[A-Za-z0-9-])", re.IGNORECASE | re.ASCII)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from the @ signs: time is linear in the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1, start):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)  # nothing before this @ can belong to a later match
        at = text.find("@", max(end, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, stop) by kind, then start."""
    out = [("email", *x) for x in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


class Plain:
    """A text under change, with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.start, self.stop = text, range(len(text)), range(1, len(text) + 1)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Put strings in the place of spans. Each new character stands for the whole span."""
        if not edits:
            return
        text, start, stop, done = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[done:a], new]
            start += [*self.start[done:a], *[self.start[a]] * len(new)]
            stop += [*self.stop[done:a], *[self.stop[b - 1]] * len(new)]
            done = b
        self.text = "".join([*text, self.text[done:]])
        self.start, self.stop = start + [*self.start[done:]], stop + [*self.stop[done:]]


def plain_char(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    return unicodedata.normalize("NFKC", c)


def plain(text: str) -> Plain | None:
    """The plain form, or None where nothing is disguised."""
    p = Plain(text)
    p.replace([(m.start(), m.end(), plain_char(m[0])) for m in _ODD.finditer(text)])
    spelled = []
    for m in _SPELLED.finditer(p.text):
        parts = list(_SPELLED_PART.finditer(p.text, m.start(), m.end()))
        if sum(bool(w[1]) for w in parts) < 3:
            continue
        for w, after in zip(parts, [*parts[1:], None]):
            if w[1]:
                spelled.append((w.start(), w.end(), DIGIT_WORDS.get(w[0].lower(), "+")))
            if after and (w[1] or after[1] or w[0] == "+") and (gap := _GAP.match(p.text, w.end(), after.start())):
                spelled.append((gap.start(), gap.end(), ""))
    p.replace(spelled)
    p.replace([(m.start(), m.end(), "@" if m[1].lower() == "at" else ".") for m in _SIGN.finditer(p.text)])
    said = [m.span() for m in _SAID.finditer(p.text)]
    if said:
        tails = [re.compile(r"[A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+", re.IGNORECASE | re.ASCII).match(p.text, b) for _, b in said]
        dots = [(m.start(), m.end(), ".") for t in tails if t for m in _SAID_DOT.finditer(p.text, t.start(), t.end())]
        p.replace(sorted({*[(a, b, "@") for a, b in said], *dots}))
    if "@" in p.text:
        spaced = []
        for m in _SPACED.finditer(p.text):
            tail = _SPACED_TAIL.match(p.text, m.end())
            spaced.append((m.start(), m.end(), "@"))
            spaced += [(tail.start() + x.start(), tail.start() + x.end(), ".") for x in re.finditer(r" \. ", tail[0])]
        p.replace(sorted(spaced))
    return None if p.text == text else p


def find_pii(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Spans of the text as it is, and those with the spans that only its plain form shows."""
    base = base_spans(text)
    p = plain(text)
    if p is None:
        return base, base
    taken = sorted((a, b) for _, a, b in base)
    more = []
    for kind, a, b in base_spans(p.text):
        a, b = p.start[a], p.stop[b - 1]
        if not any(x < b and a < y for x, y in taken):
            more.append((kind, a, b))
    return base, sorted([*base, *more], key=lambda x: (KINDS.index(x[0]), x[1]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def pii_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, the base spans and all spans as text, and base counts.

    A null text is empty and has none. Ids may be null or repeat; every row is read by
    itself and nothing is shuffled. Other columns are ignored.
    """
    rows = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))

    def make():
        def scan(b):
            found = [find_pii(t) for t in b["text"]]
            counts = {f"n_{k}": [sum(x[0] == k for x in base) for base, _ in found] for k in KINDS}
            return counts | {"base": [joined(base) for base, _ in found], "spans": [joined(all_) for _, all_ in found]}

        return scan

    out = python_map(rows, make, ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string", ["doc_id"])
    return out.withColumn("base_sha256", F.sha2("base", 256)).drop("base")
