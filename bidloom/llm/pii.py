"""Personal data in texts, plain or disguised, with exact source positions.

Plain identifiers (the base spans) are found in the text as it stands. Then small
transducers rewrite a copy: homoglyphs become ASCII, bracketed or spelled "at" and
"dot" (and HTML's entities for them) become @ and ., spelled digits become digits. A
spelled "at" counts only before a domain that ends in a known top-level name. Each rewriting keeps, for every
character it puts out, where in the source it came from; identifiers found in the
rewritten text are mapped back to source positions through these offsets. A span
found this way is added if the rewriting changed something in it and no base span of
its kind overlaps it; base spans always stay.

Every pattern is linear in the text: each scan starts at the first character of a
run and never twice inside one.

Rules, by case: null counts as empty and has no spans; texts of any length are
scanned whole; repeated rows are scanned each; positions count code points, the end
is exclusive; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

from pyspark.sql import DataFrame

from .common import map_arrow

KINDS = ("email", "ip", "card", "phone")

DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9][0-9.]*")
QUAD = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    out, free = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            at = start = m.start()
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                free = m.end()
    return out


def ips(text: str) -> list[tuple[int, int]]:
    out = []
    for run in DOTTED.finditer(text):
        if run[0].count(".") >= 3:
            for m in QUAD.finditer(text, run.start(), run.end()):
                if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                    out.append(m.span())
    return out


def luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(x - 9 * (x > 9) for x in twice)) % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in PLUS.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def found(text: str) -> dict[str, list[tuple[int, int]]]:
    return {k: f(text) for k, f in FINDERS.items()}


# Characters that look like ASCII ones, beside those whose
# compatibility form (NFKC) is one ASCII character.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "З": "3",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I",
    "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "․": ".", "。": ".", "·": ".", "‐": "-", "‑": "-",
    "–": "-", "−": "-",
}
#: Characters that show nothing.
INVISIBLE = ("­", "​", "‌", "‍", "⁠", "﻿")
# The digits' names.
DIGIT_NAMES = {
    "0": ("zero", "oh", "null", "zéro", "cero"),
    "1": ("one", "eins", "un", "uno"),
    "2": ("two", "zwei", "deux", "dos"),
    "3": ("three", "drei", "trois", "tres"),
    "4": ("four", "vier", "quatre", "cuatro"),
    "5": ("five", "fünf", "cinq", "cinco"),
    "6": ("six", "sechs", "seis"),
    "7": ("seven", "sieben", "sept", "siete"),
    "8": ("eight", "acht", "huit", "ocho"),
    "9": ("nine", "neun", "neuf", "nueve"),
}
DIGIT_OF = {name: d for d, names in DIGIT_NAMES.items() for name in names}
TIMES = {"double": 2, "triple": 3}
AT_NAMES = "at|@|arroba|arobase|ät"
DOT_NAMES = r"dot|\.|punkt|point|punto"
# HTML's spellings of the signs.
ENTITIES = {"&#64;": "@", "&#x40;": "@", "&commat;": "@", "&#46;": ".", "&#x2e;": ".", "&period;": "."}
# Top-level names that end a spoken address; those that are common English words are left out.
TOPS = "com|org|net|edu|gov|mil|int|info|biz|io|co|dev|app|ai|eu|uk|de|fr|es|pt|nl|be|ch|se|dk|fi|pl|cz|ru|cn|jp|kr|br|mx|ca|au|nz|ie|us|example|test|invalid"

# All patterns below read texts in small letters.
SPELLED = "|".join(sorted(DIGIT_OF, key=len, reverse=True))
ONE = rf"(?:(?:double|triple)[ -]{{1,3}})?(?:{SPELLED})"
NUMBER = re.compile(rf"\b(?:plus[ ]{{1,3}})?{ONE}(?:[ ,-]{{1,3}}(?:{ONE}|dot|point|[0-9]+)\b)+")
IN_NUMBER = re.compile(r"[^\W\d_]+|[0-9]+")
BLANKS = " \t"
BRACKETED = re.compile(rf"[\[({{<][ ]{{0,3}}(?:({AT_NAMES})|{DOT_NAMES})[ ]{{0,3}}[\])}}>]")
ENTITY = re.compile("|".join(map(re.escape, ENTITIES)))
LABEL = "[a-z0-9-]{1,63}"
A_DOT = rf"(?:\.|[ ]{{1,3}}dot[ ]{{1,3}}|[ ]{{0,3}}[\[({{<][ ]{{0,3}}(?:{DOT_NAMES})[ ]{{0,3}}[\])}}>][ ]{{0,3}})"
AN_AT = rf"(?:@|[ ]{{1,3}}at[ ]{{1,3}}|[ ]{{0,3}}[\[({{<][ ]{{0,3}}(?:{AT_NAMES})[ ]{{0,3}}[\])}}>][ ]{{0,3}})"
TOP = rf"(?:{TOPS})(?![a-z0-9-])"
#: A spelled "at" before a domain with a disguised dot and a known top-level name.
SPOKEN_AT = re.compile(rf"(?<=[a-z0-9])[ ]{{1,3}}at[ ]{{1,3}}(?=(?:{LABEL}{A_DOT}){{1,6}}{TOP})(?!(?:{LABEL}\.){{1,6}}{TOP})")
#: A spelled "dot" between digits, before a top-level name, or in the local part.
SPOKEN_DOT = re.compile(rf"(?<=[0-9])[ ]{{1,3}}dot[ ]{{1,3}}(?=[0-9])|(?<=[a-z0-9])[ ]{{1,3}}dot[ ]{{1,3}}(?=(?:[a-z0-9._%+-]{{1,64}}(?:[ ]{{1,3}}dot[ ]{{1,3}}[a-z0-9._%+-]{{1,64}}){{0,3}}{AN_AT})?(?:{LABEL}{A_DOT}){{0,6}}{TOP})")


def _folds() -> dict[str, str]:
    """What each look-alike becomes; compatibility forms by rule, over the blocks that hold them."""
    table = dict(LOOKALIKES) | dict.fromkeys(INVISIBLE, "")
    blocks = ((0x2070, 0x20A0), (0x2100, 0x2190), (0x2460, 0x24F0), (0xFE50, 0xFE70), (0xFF01, 0xFF5F), (0x1D400, 0x1D800))
    for first, end in blocks:
        for c in map(chr, range(first, end)):
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and plain.isascii() and plain.isprintable():
                table.setdefault(c, plain)
    for first in (0x660, 0x6F0, 0x966):  # other decimal digits
        table |= {chr(first + d): str(d) for d in range(10)}
    return table


FOLDS = _folds()
FOLDED = frozenset(FOLDS)

Edit = tuple[int, int, str]


class Rewritten:
    """A text after edits, with the way back to the positions before them."""

    def __init__(self, text: str, edits: list[Edit]):
        pieces, self.at, self.source, self.kept = [], [], [], []
        done = out = 0
        for start, end, put in edits:
            for a, b, s, same in ((done, start, text[done:start], True), (start, end, put, False)):
                if s:
                    pieces.append(s)
                    self.at.append(out)
                    self.source.append((a, b))
                    self.kept.append(same)
                    out += len(s)
            done = end
        if done < len(text):
            pieces.append(text[done:])
            self.at.append(out)
            self.source.append((done, len(text)))
            self.kept.append(True)
        self.text = "".join(pieces)

    def back(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        left = self.source[i][0] + (start - self.at[i] if self.kept[i] else 0)
        right = self.source[j][0] + end - self.at[j] if self.kept[j] else self.source[j][1]
        return left, right


def fold_edits(text: str) -> list[Edit]:
    # A look-alike is found by the set of a text's characters first: most texts hold none.
    if text.isascii() or FOLDED.isdisjoint(text):
        return []
    return [(k, k + 1, FOLDS[c]) for k, c in enumerate(text) if c in FOLDED]


def small(text: str) -> str:
    """A text in small letters, each at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


def sign_edits(text: str) -> list[Edit]:
    """At and dot disguises; where two overlap, the first stays."""
    low, edits = small(text), []
    if any(c in low for c in "[({<"):
        for m in BRACKETED.finditer(low):
            start, end = m.span()
            while start and m.start() - start < 3 and low[start - 1] in BLANKS:
                start -= 1
            while end < len(low) and end - m.end() < 3 and low[end] in BLANKS:
                end += 1
            edits.append((start, end, "@" if m[1] else "."))
    if "&" in low:
        edits += [(*m.span(), ENTITIES[m[0]]) for m in ENTITY.finditer(low)]
    if " dot " in low:
        edits += [(*m.span(), ".") for m in SPOKEN_DOT.finditer(low)]
    if " at " in low:
        edits += [(*m.span(), "@") for m in SPOKEN_AT.finditer(low)]
    out, free = [], 0
    for e in sorted(edits):
        if e[0] >= free:
            out.append(e)
            free = e[1]
    return out


def digit_edits(text: str) -> list[Edit]:
    low = small(text)
    # Most texts hold no digit's name as a word.
    if DIGIT_OF.keys().isdisjoint(low.replace("-", " ").replace(",", " ").split()):
        return []
    out = []
    for m in NUMBER.finditer(low):
        put, times = "", 1
        for w in IN_NUMBER.findall(m[0]):
            if w in TIMES:
                times = TIMES[w]
                continue
            put += ("+" if w == "plus" else "." if w in ("dot", "point") else DIGIT_OF.get(w, w)) * times
            times = 1
        out.append((*m.span(), put))
    return out


def added(text: str, base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """Spans that only the rewritten text shows, in source positions."""
    steps, now = [], text
    for transducer in (fold_edits, digit_edits, sign_edits):
        if edits := transducer(now):
            steps.append(Rewritten(now, edits))
            now = steps[-1].text
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not steps:
        return out
    for kind, spans in found(now).items():
        taken = base[kind]
        k = 0
        for s, e in spans:
            a, b = s, e
            for step in reversed(steps):
                a, b = step.back(a, b)
            if text[a:b] == now[s:e]:
                continue
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if k == len(taken) or taken[k][0] >= b:
                out[kind].append((a, b))
    return out


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in spans[k])


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per span: doc_id, kind, start, end, value, disguised."""

    def each(doc_ids, texts):
        rows = []
        for i, t in zip(doc_ids, texts, strict=True):
            t = t or ""
            base = found(t)
            for more, part in ((False, base), (True, added(t, base))):
                rows += [(i, k, s, e, t[s:e], more) for k in KINDS for s, e in part[k]]
        names = ("doc_id", "kind", "start", "end", "value", "disguised")
        yield {n: [r[c] for r in rows] for c, n in enumerate(names)}

    return map_arrow(docs.select(id_col, text_col), each, "doc_id long, kind string, start int, end int, value string, disguised boolean")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and digest of the base spans, then all spans and how many were added."""

    def each(doc_ids, texts):
        cols = {k: [] for k in ("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added")}
        for i, t in zip(doc_ids, texts, strict=True):
            t = t or ""
            base = found(t)
            more = added(t, base)
            cols["doc_id"].append(i)
            for k in KINDS:
                cols[f"n_{k}"].append(len(base[k]))
            cols["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            cols["spans"].append(joined({k: sorted(base[k] + more[k]) for k in KINDS}))
            cols["n_added"].append(sum(map(len, more.values())))
        yield cols

    return map_arrow(docs.select(id_col, text_col), each, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
