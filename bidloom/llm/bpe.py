"""Byte-pair encoding and decoding, exact and in linear time.

A word is cut by backtracking over its longest vocabulary matches. One pass of an
Aho-Corasick automaton (over the reversed tokens and the reversed word) finds the
longest token that starts at each place; shorter ones follow from a table of each
token's longest proper prefix. Two neighbours may stand together only if merging
would not cross the seam between them, which a pair-compatibility table answers: each
token keeps its left and right spine, the symbols that stood at its edges while it
was merged and when each was merged away. A place that was given up is never tried
again, so a word costs linear time.

Ids become text again through an offset table: all tokens' strings in one blob and
where each begins.

The file format is that of the ``tokenizers`` library (BPE with an end-of-word
suffix, NFC, white space runs to one space, lower case, words by pattern, bytes as
printable characters). Only the vocabulary and the merges are read from it.

Rules, by case: null counts as empty and gives no ids; white space alone gives no
ids; an added token's own text becomes that token's id, with its flags; texts of any
length are encoded whole; repeated rows are encoded each; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_arrow

#: Fixed values of the file format: how texts are cut into words, letters and numbers by Unicode's classes.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Letters and numbers that Unicode 16 has beyond 15.1, as first and last code point.
LETTERS_16 = "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b-1138b 1138e-1138e 11390-113b5 113b7-113b7 113d1-113d1 113d3-113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff-18cff 1e5d0-1e5ed 1e5f0-1e5f0"
NUMBERS_16 = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"
# Capitals newer than Unicode 15.1 (runs of code points) and the first one's small letter.
NEW_CAPITALS = {"1c89-1c89": "1c8a", "a7cb-a7cb": "264", "a7cc-a7cc": "a7cd", "a7ce-a7ce": "a7cf", "a7d2-a7d2": "a7d3", "a7d4-a7d4": "a7d5", "a7da-a7da": "a7db", "a7dc-a7dc": "19b", "10d50-10d65": "10d70", "16ea0-16eb8": "16ebb"}
#: No character before this one was assigned after Unicode 15.1.
FIRST_RARE = 0x558
EXOTIC = re.compile(f"[^\0-{chr(FIRST_RARE - 1)}]")
#: Marks the end of a word inside the automaton; bytes never map to it.
END = "\0"
#: Words whose ids a worker keeps before it starts anew.
CACHE = 200_000


def _ranges(of: str) -> list[tuple[int, int]]:
    return [(int(a, 16), int(b, 16)) for a, b in (r.split("-") for r in of.split())]


@lru_cache(maxsize=None)
def rare(c: str) -> bool:
    """Whether tables of Unicode 15.1 don't know a character: later tables may call it a letter, the library's (16) may not."""
    return unicodedata.category(c) == "Cn"


def has_rare(text: str) -> bool:
    return not text.isascii() and EXOTIC.search(text) is not None and any(map(rare, set(text)))


@lru_cache(maxsize=1)
def small_letters() -> dict[int, int]:
    return {c: int(small, 16) + c - a for run, small in NEW_CAPITALS.items() for a, b in _ranges(run) for c in range(a, b + 1)}


@lru_cache(maxsize=1)
def exact_words() -> re.Pattern:
    """``WORDS`` with the classes of Unicode 16, spelled out as ranges: for texts with rare characters."""
    runs: dict[str, list[tuple[int, int]]] = {"L": [], "N": []}
    for c in range(sys.maxunicode + 1):
        if (kind := unicodedata.category(chr(c))[0]) in runs:
            of = runs[kind]
            of[-1:] = [(of[-1][0], c)] if of and of[-1][1] == c - 1 else [*of[-1:], (c, c)]
    classes = {k: "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in of) for k, of in (("L", runs["L"] + _ranges(LETTERS_16)), ("N", runs["N"] + _ranges(NUMBERS_16)))}
    blank = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    return re.compile(WORDS.replace(r"\p{L}", classes["L"]).replace(r"\p{N}", classes["N"]).replace(r"\s", blank))


def added_pattern(tokens: list[dict]) -> re.Pattern | None:
    """Finds added tokens, the longest first; blanks beside them and whole words as their flags say."""
    parts = []
    for t in sorted(tokens, key=lambda t: len(t["content"]), reverse=True):
        word = rf"(?<!\w){re.escape(t['content'])}(?!\w)" if t["single_word"] else re.escape(t["content"])
        parts.append((r"\s*" if t["lstrip"] else "") + f"({word})" + (r"\s*" if t["rstrip"] else ""))
    return re.compile("|".join(parts)) if parts else None


def printable_bytes() -> list[str]:
    """The printable character of each byte: itself where it is printable, else the next from U+0100 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown, fresh = {b: chr(b) for b in keep}, 256
    for b in range(256):
        if b not in shown:
            shown[b], fresh = chr(fresh), fresh + 1
    return [shown[b] for b in range(256)]


class Encoder:
    """Encodes and decodes with the vocabulary and merges of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # Tokens that are sought in the text as it stands, and those sought in the normalised one.
        self.plain = added_pattern([t for t in spec["added_tokens"] if not t["normalized"]])
        self.normal = added_pattern([t for t in spec["added_tokens"] if t["normalized"]])
        self.words = regex.compile(WORDS)
        self.bytes = printable_bytes()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): k for k, (a, b) in enumerate(merges)}
        parts: dict[int, tuple[int, int, int]] = {}
        for k, (a, b) in enumerate(merges):
            parts.setdefault(self.vocab[a + b], (self.vocab[a], self.vocab[b], k))
        self.parts = parts
        self._build_table(self.vocab | self.added)
        self._build_automaton()
        self.spines: dict[tuple[int, bool], list[tuple[int, float]]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[str, int, str]] = {}

    def _build_table(self, all_tokens: dict[str, int]) -> None:
        by_id = sorted((i, t) for t, i in all_tokens.items())
        size = by_id[-1][0] + 1
        lengths = np.zeros(size + 1, np.int64)
        for i, t in by_id:
            lengths[i + 1] = len(t)
        self.offsets = np.cumsum(lengths).tolist()
        self.blob = "".join(t for _, t in by_id)

    def _build_automaton(self) -> None:
        spelled = {}
        for token, i in self.vocab.items():
            ends = bool(self.suffix) and token.endswith(self.suffix) and token != self.suffix
            spelled[(token[: -len(self.suffix)] + END) if ends else token] = i
        # Only what merging can make: single symbols and results of merges.
        spelled = {t: i for t, i in spelled.items() if i in self.parts or len(t.rstrip(END)) == 1}
        self.automaton = ahocorasick.Automaton()
        for t, i in spelled.items():
            self.automaton.add_word(t[::-1], (len(t), i))
        self.automaton.make_automaton()
        self.length = {i: len(t) for t, i in spelled.items()}
        self.shorter: dict[int, int] = {}
        for t, i in spelled.items():
            for n in range(len(t) - 1, 0, -1):
                if (j := spelled.get(t[:n])) is not None:
                    self.shorter[i] = j
                    break

    def _spine(self, token: int, right: bool) -> list[tuple[int, float]]:
        """Symbols that stood at one edge of ``token``, each with the rank of the merge that took it away."""
        if (known := self.spines.get((token, right))) is None:
            known, gone, at = [], float("inf"), token
            while True:
                known.append((at, gone))
                if at not in self.parts:
                    break
                a, b, gone = self.parts[at]
                at = b if right else a
            self.spines[token, right] = known
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether merging leaves the seam between ``left`` and ``right`` alone."""
        known = self.pairs.get((left, right))
        if known is None:
            known = True
            for a, a_gone in self._spine(left, True):
                for b, b_gone in self._spine(right, False):
                    rank = self.rank.get((a, b))
                    # Of equal merges the leftmost is done first.
                    if rank is not None and rank < a_gone and rank <= b_gone:
                        known = False
                        break
                if not known:
                    break
            if len(self.pairs) > CACHE:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word, given as printable bytes."""
        text = word + END if self.suffix else word
        n = len(text)
        longest: list[int | None] = [None] * n
        lengths = [0] * n
        for end, (size, token) in self.automaton.iter(text[::-1]):
            at = n - 1 - end
            if size > lengths[at]:
                lengths[at], longest[at] = size, token
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            while token is not None:
                after = at + self.length[token]
                if not dead[after] and (not out or self.fits(out[-1], token)):
                    break
                token = self.shorter.get(token)
            if token is None:  # nothing fits here: give this place up and shorten what led to it
                dead[at] = 1
                if not out:
                    raise ValueError(f"the vocabulary can't spell {word!r}")
                token = out.pop()
                at -= self.length[token]
                token = self.shorter.get(token)
                continue
            out.append(token)
            at = after
            token = longest[at] if at < n else None
        return out

    def _known(self, word: str) -> tuple[str, int, str]:
        ids = self.word_ids("".join([self.bytes[b] for b in word.encode("utf-8", "surrogatepass")]))
        found = (" ".join(map(str, ids)), len(ids), self.decode(ids))
        if len(self.cache) >= CACHE:
            self.cache.clear()
        self.cache[word] = found
        return found

    def pieces(self, text: str | None) -> list[tuple[str, int, str]]:
        """Of each word or added token: its ids as text, how many, and its tokens as text."""
        out: list[tuple[str, int, str]] = []
        for part, token in self._parted(text or "", self.plain):
            if token is not None:
                out.append(token)
                continue
            for piece, token in self._parted(self._lowered(part), self.normal):
                if token is not None:
                    out.append(token)
                else:
                    known = self.cache
                    out += [known.get(word) or self._known(word) for word in self._cut(piece)]
        return out

    def _lowered(self, text: str) -> str:
        """Composed, and lower case by single characters: no final sigma."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return text.translate(small_letters()) if has_rare(text) else text

    def _cut(self, text: str) -> list[str]:
        return (exact_words() if has_rare(text) else self.words).findall(text)

    def _parted(self, text: str, pattern: re.Pattern | None) -> Iterator[tuple[str, tuple[str, int, str] | None]]:
        """The text between added tokens, and the tokens."""
        at = 0
        for m in pattern.finditer(text) if pattern else ():
            if m.start() > at:
                yield text[at : m.start()], None
            i = self.added[m[m.lastindex]]
            yield "", (str(i), 1, self.decode([i]))
            at = m.end()
        if at < len(text):
            yield text[at:], None

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids, _, _ in self.pieces(text) for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The tokens of ``ids``, with a space between: these files name no decoder."""
        o, blob = self.offsets, self.blob
        return " ".join([blob[o[i] : o[i + 1]] for i in ids])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of every document: doc_id, ids array<int>, decoded."""
    path = path or default_path()

    def each(doc_ids, texts):
        tool = encoder(path)
        ids = [tool.encode(t) for t in texts]
        yield {"doc_id": doc_ids, "ids": ids, "decoded": [tool.decode(i) for i in ids]}

    return map_arrow(docs.select(id_col, text_col), each, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the same: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = path or default_path()
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def each(doc_ids, texts):
        tool = encoder(path)
        counts, ids, back = [], [], []
        for t in texts:
            found = tool.pieces(t)
            counts.append(sum([p[1] for p in found]))
            ids.append(sha(" ".join([p[0] for p in found])))
            back.append(sha(" ".join([p[2] for p in found])))
        yield {"doc_id": doc_ids, "n_tokens": counts, "ids_sha256": ids, "decoded_sha256": back}

    return map_arrow(docs.select(id_col, text_col), each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
