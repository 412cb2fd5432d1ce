"""Personal data in texts, plain or disguised, with spans in the source's own characters.

Plain identifiers are found by four patterns on the text as it is. Then the text goes through
transducers that also keep, for every character they write, the source span it came from:

* look-alikes: full-width and other compatibility forms of one character, Cyrillic and Greek letters that
  look Latin, digits of other scripts; characters without width or show are dropped;
* at and dot: ``name [at] mail [dot] com``, ``name (at) mail dot com`` and the like become ``name@mail.com``;
* spelled digits: runs of at least seven digit words (English, French, German, Spanish) become digits.

The same patterns run on the rewritten text; a find that a rewriting touched is mapped back to the source
and added, unless it overlaps a plain span of its kind. Plain spans always stay. A transducer is only run
on a text that has a character or word which it could rewrite, which changes no result.

Defined cases: a null text counts as empty and has no spans; texts are searched whole, whatever their length;
every row is treated for itself, so repeated rows, ties and null ids are kept; an empty table gives an empty
result; further columns are untouched by ``redact`` and ignored by ``find``.
"""
from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from epochloom.llm.common import text_of

KINDS = ("email", "ip", "card", "phone")
# The four patterns of plain identifiers.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: The same matches, which can only begin where a run of digits does, without trying the rest of a long run.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# Cyrillic and Greek letters that look like Latin ones.
LOOKALIKE = dict(zip(
    "АВСЕНІЈКМОРЅТХУаеіјорсухѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονι",
    "ABCEHIJKMOPSTXYaeijopcyxsdqwABEZHIKMNOPTYXovi",
))
# Digit words.
DIGIT_WORDS = {
    word: digit
    for digit, words in enumerate((
        "zero oh null cero zéro", "one un eins ein uno une", "two deux zwei zwo dos", "three trois drei tres",
        "four quatre vier cuatro", "five cinq fünf cinco", "six sechs seis", "seven sept sieben siete",
        "eight huit acht ocho", "nine neuf neun nueve",
    ))
    for word in words.split()
}
_ONE = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
#: At least seven digits, at least three of them spelled, apart by blanks, commas, hyphens or nothing but a blank.
SPELLED = re.compile(rf"(?<!\w)(?:plus\s{{1,8}})?(?:(?:{_ONE}|[0-9])(?:\s{{0,8}}[,-]\s{{0,8}}|\s{{1,8}})){{6,}}(?:{_ONE}|[0-9]+)(?!\w)", re.I)
SPELLED_ITEM = re.compile(rf"plus|{_ONE}|[0-9]", re.I)
#: ``[at]``, ``(at)``, ``{at}``, or the bare word between what can be a name and a host with a spelled dot.
AT = re.compile(r"\s{0,8}[\[({<]\s{0,8}(?:at|@|arroba|ät)\s{0,8}[\])}>]\s{0,8}", re.I)
_SEP = r"(?:\s{0,8}[\[({<]\s{0,8}(?:dot|point|punkt|punto|\.)\s{0,8}[\])}>]\s{0,8}|\s{1,8}(?:dot|punto)\s{1,8})"
#: A bare word counts only before a host that ends like one, so that prose about dots stays prose.
BARE_AT = re.compile(
    rf"(?<=[A-Za-z0-9_%+-])\s{{1,8}}(?:at|arroba)\s{{1,8}}(?=[A-Za-z0-9-]+(?:{_SEP}[A-Za-z0-9-]+)*{_SEP}(?:[A-Za-z]{{2,3}}|info|name|example|test)(?![\w-]))", re.I
)
SPACED_AT = re.compile(r"(?<=[A-Za-z0-9_%+-])(?: {1,8}@ {0,8}| {0,8}@ {1,8})(?=[A-Za-z0-9-]+(?: {0,8}\. {0,8}| {1,8}dot {1,8})[A-Za-z0-9-]+)", re.I)
DOT = re.compile(r"\s{0,8}[\[({<]\s{0,8}(?:dot|point|punkt|punto|\.)\s{0,8}[\])}>]\s{0,8}", re.I)
BARE_DOT = re.compile(r"(?<=[A-Za-z0-9-])\s{1,8}(?:dot|punto)\s{1,8}(?=[A-Za-z0-9-])", re.I)
_HOST = re.compile(
    r"@[A-Za-z0-9-]+(?:(?:\.|\s{1,8}(?:dot|punto)\s{1,8}|\s{0,8}[\[({<]\s{0,8}(?:dot|point|punkt|punto|\.)\s{0,8}[\])}>]\s{0,8})[A-Za-z0-9-]+)*", re.I
)
_ODD = re.compile("[^\x00-ſ]|[\xad²³¹]")
_HINT = re.compile(r"[\[({<]|\b(?:at|arroba|dot|punto)\b| @|@ ", re.I)
_SPELLED_HINT = re.compile(rf"(?<!\w)(?:{_ONE})[\s,-]+(?:{_ONE}|[0-9])(?!\w)", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if k % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def plain_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost spans of each kind that pass its test."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    # finding the signs first spares the patterns on long runs that cannot match; the result is that of finditer
    if "@" in text:
        out["email"] = _emails(text)
    for m in _IP.finditer(text):
        if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() >= 13 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out["phone"].append(m.span())
    return out


_NAME_AT = re.compile(r"[A-Za-z0-9_%+-]{1,64}@")
_TAIL = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> list[tuple[int, int]]:
    """Spans of ``EMAIL``, from each at sign backwards, so that long words without one cost nothing."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _NAME:
            start -= 1
        m = _TAIL.match(text, at) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


# --- transducers ------------------------------------------------------------------------


class Traced:
    """A rewritten text as a chain of stretches; each maps to a span of the source."""

    def __init__(self, text: str):
        self.text = text
        #: (place in the text, place in the source, whether rewritten, end in the source) of each stretch.
        self.stretches: list[tuple[int, int, bool, int]] = [(0, 0, False, len(text))]
        self._at: list[int] = [0]

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span of a span here, and whether a rewriting touched it."""
        first = bisect_right(self._at, start) - 1
        last = bisect_right(self._at, end - 1) - 1
        at, src, changed, stop = self.stretches[first]
        begin = src if changed else src + (start - at)
        at, src, changed, stop = self.stretches[last]
        finish = stop if changed else src + (end - at)
        # characters that were dropped leave no stretch, but make the source span longer
        return begin, finish, finish - begin != end - start or any(self.stretches[k][2] for k in range(first, last + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> "Traced":
        """Replace spans of this text, in order; every edit becomes one stretch."""
        out = Traced("")
        parts, stretches, size, last = [], [], 0, 0

        def copy(start: int, end: int) -> None:
            nonlocal size
            k = bisect_right(self._at, start) - 1
            while start < end:
                at, src, changed, stop = self.stretches[k]
                limit = self._at[k + 1] if k + 1 < len(self._at) else len(self.text)
                upto = min(end, limit)
                if changed:
                    stretches.append((size, src, True, stop))
                else:
                    stretches.append((size, src + start - at, False, src + upto - at))
                parts.append(self.text[start:upto])
                size += upto - start
                start, k = upto, k + 1

        for start, end, new in edits:
            copy(last, start)
            begin, finish, _ = self.source(start, end)
            if new:
                stretches.append((size, begin, True, finish))
                parts.append(new)
                size += len(new)
            last = end
        copy(last, len(self.text))
        out.text = "".join(parts)
        out.stretches = stretches or [(0, 0, False, 0)]
        out._at = [s[0] for s in out.stretches]
        return out


@lru_cache(maxsize=4096)
def plain_form(char: str) -> str | None:
    """What a look-alike stands for; None for a character that stays."""
    if char in LOOKALIKE:
        return LOOKALIKE[char]
    kind = unicodedata.category(char)
    if kind == "Cf":
        return ""
    if kind == "Nd":
        return str(unicodedata.decimal(char))
    other = unicodedata.normalize("NFKC", char)
    return other if len(other) == 1 and other != char and other.isascii() and other.isprintable() else None


def normalised(text: str) -> Traced | None:
    """The text behind its disguises, or None if no transducer rewrites it."""
    traced, touched = Traced(text), False
    if _ODD.search(text):
        edits = [(m.start(), m.end(), new) for m in _ODD.finditer(text) if (new := plain_form(m[0])) is not None]
        if edits:
            traced, touched = traced.rewrite(edits), True
    if _HINT.search(traced.text):
        for pattern, sign in ((AT, "@"), (BARE_AT, "@"), (SPACED_AT, "@"), (DOT, "."), (BARE_DOT, ".")):
            edits = []
            for m in pattern.finditer(traced.text):
                if sign == "@" and not (m.start() and traced.text[m.start() - 1] in _NAME):
                    continue
                if sign == "." and not _host_before(traced.text, m.start()):
                    # else a dot counts only in the name before an at sign, or between digits
                    digits = traced.text[m.start() - 1 : m.start()].isdigit() and traced.text[m.end() : m.end() + 1].isdigit()
                    if not digits and not _NAME_AT.match(traced.text, m.end()):
                        continue
                edits.append((m.start(), m.end(), sign))
            if edits:
                traced, touched = traced.rewrite(edits), True
    if _SPELLED_HINT.search(traced.text):
        edits = []
        for m in SPELLED.finditer(traced.text):
            items = SPELLED_ITEM.findall(m[0])
            if sum(not i.isdigit() for i in items) >= 3:
                edits.append((m.start(), m.end(), "".join(
                    "+" if i.lower() == "plus" else i if i.isdigit() else str(DIGIT_WORDS[i.lower()]) for i in items
                )))
        if edits:
            traced, touched = traced.rewrite(edits), True
    return traced if touched else None


def _host_before(text: str, end: int) -> bool:
    """Whether what stands before ``end`` is a host that follows an at sign, its dots spelled or not."""
    part = text[max(0, end - 320) : end]  # a host has at most 253 characters
    at = part.rfind("@")
    return at >= 0 and _HOST.fullmatch(part, at) is not None


def all_spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Plain spans, and plain and disguised ones, of each kind in order."""
    plain = plain_spans(text)
    traced = normalised(text)
    if traced is None:
        return plain, plain
    full = {k: list(v) for k, v in plain.items()}
    for kind, spans in plain_spans(traced.text).items():
        for start, end in spans:
            begin, finish, changed = traced.source(start, end)
            if changed and not any(begin < e and s < finish for s, e in plain[kind]):
                full[kind].append((begin, finish))
        full[kind].sort()
    return plain, full


def _joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in spans[k])


FOUND = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
)


@F.pandas_udf(FOUND)
def _find(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        plain, full = all_spans(text)
        rows.append([len(plain[k]) for k in KINDS] + [hashlib.sha256(_joined(plain).encode()).hexdigest(), _joined(full)])
    return pd.DataFrame(rows, columns=[f"n_{k}" for k in KINDS] + ["base_sha256", "spans"])


@F.pandas_udf(T.StringType())
def _redact(texts: pd.Series) -> pd.Series:
    return texts.map(redacted)


def redacted(text: str) -> str:
    """The text with every span, plain or disguised, replaced by its kind in angle brackets."""
    _, full = all_spans(text)
    spans = sorted((s, -e, k) for k in KINDS for s, e in full[k])
    out, last = [], 0
    for start, end, kind in spans:
        if start >= last:
            out += [text[last:start], f"<{kind.upper()}>"]
        last = max(last, -end)
    return "".join(out) + text[last:]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the counts and digest of plain spans, and all spans as ``kind:start:end``."""
    return docs.select(F.col(id_col).alias("doc_id"), _find(text_of(text_col)).alias("f")).select("doc_id", "f.*")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with spans replaced in the text; a null text stays null."""
    new: Column = F.when(F.col(text_col).isNotNull(), _redact(text_of(text_col)))
    return docs.withColumn(text_col, new)
