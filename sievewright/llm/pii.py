"""Personal data by offset-preserving deobfuscation.

Base spans (email, ip, card, phone) are found in the text as it stands. Where a text shows signs of
disguise, three transducers rewrite it in turn: homoglyphs and invisible characters; spelled digits;
at / dot disguises. Each keeps, for every character of its output, the span of source characters
it stands for. The same detectors run on the text after each step, and also with at / dot disguises
rewritten but spelled digits left; what they find is mapped back to the source. Base spans always
stay; an added span is one that no base span of its kind contains, so
the whole of an address is added where the base rules see a fragment of it. Digits, at, dot and plus
are read in English, French, German and Spanish.

Defined results: a null text counts as empty and has no spans; offsets are code points of the
source, end exclusive; equal spans count once, and spans with one start go by kind as listed;
repeated rows get the same result; texts of any length are read whole, in linear time; an empty
table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.common import narrow

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, place in KINDS, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A failed run of digits can't succeed from a later digit, so the look-behind only saves time.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches: from each @ with a domain, the local part reaches back as far as it can."""
    last = 0
    for m in _DOMAIN.finditer(text):
        start = at = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            last = m.end()
            yield start, 0, last


def detect(text: str) -> list[Span]:
    """Spans of all kinds by start, then kind."""
    found: list[Span] = list(_emails(text)) if "@" in text else []
    if "." in text:
        for m in _IP.finditer(text):
            # Long runs of digits are above 255 whatever they are.
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _DIGITS.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    found.sort()
    return found


# Look-alike characters by the ASCII character they stand for.
_LOOKALIKES = {
    "a": "аα", "c": "сϲ", "e": "еε", "i": "іι", "j": "ј", "k": "к", "l": "ӏ", "o": "оο", "p": "рρ", "s": "ѕ", "u": "υ",
    "v": "ν", "x": "хχ", "y": "у", "h": "һ", "d": "ԁ", "n": "ո", "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ",
    "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "Υ",
    "Z": "Ζ", "-": "‐‑‒–−﹣", ".": "․。｡·", "@": "﹫", "+": "﹢",
}
_INVISIBLE = "­​‌‍⁠﻿"
# Digits by name in English, French, German and Spanish, in order of the digit.
_DIGIT_NAMES = {
    "en": "zero one two three four five six seven eight nine",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
_MORE_NAMES = {"oh": "0", "zwo": "2", "fuenf": "5"}
# What stands for @, a dot and + when said.
_AT_NAMES = ("at", "arobase", "arroba", "klammeraffe")
_DOT_NAMES = ("dot", "point", "punkt", "punto")
_PLUS_NAMES = ("plus", "más")
# End of fixed values.
_SPELLED = {name: str(k) for names in _DIGIT_NAMES.values() for k, name in enumerate(names.split())} | _MORE_NAMES
_AT_SAID, _DOT_SAID = (f"(?:{'|'.join(names)})" for names in (_AT_NAMES, _DOT_NAMES))


def _homoglyph_table() -> dict[int, str]:
    table = {ord(c): plain for plain, alike in _LOOKALIKES.items() for c in alike}
    table |= {0xFEE0 + k: chr(k) for k in range(0x21, 0x7F)}  # full-width forms
    table |= {zero + d: str(d) for zero in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
    # Mathematical letters, that is all characters of that block that normalise to an ASCII letter.
    table |= {k: plain for k in range(0x1D400, 0x1D6A8) if len(plain := unicodedata.normalize("NFKC", chr(k))) == 1 and plain.isascii()}
    table |= {ord(c): "" for c in _INVISIBLE}
    return table | {0x00A0: " ", 0x3000: " "}


_HOMOGLYPHS = _homoglyph_table()
# One range for all mathematical letters and digits; a long list of them would be searched one by one.
_ODD = re.compile("[" + "".join(re.escape(chr(k)) for k in sorted(_HOMOGLYPHS) if k < 0x10000) + "\U0001d400-\U0001d7ff]")
_DIGIT_WORD = rf"(?:{'|'.join(sorted(_SPELLED, key=lambda w: (-len(w), w)))})"
_DIGIT_TOKEN = re.compile(rf"(?i)(?<![^\W\d_])(?P<words>{_DIGIT_WORD}+)(?![^\W\d_])|[0-9]+")
_ONE_WORD = re.compile(rf"(?i){_DIGIT_WORD}")
_JOINT = re.compile(r"[\s,.-]*+")
_BETWEEN = re.compile(rf"(?i)(?:[\s,.()\[\]{{}}<>-]|{_DOT_SAID}(?![A-Za-z]))*+")
# Where spelled digits may matter, in lower-cased text: beside other digits. It begins with the names
# themselves, so that the search skips to their initials.
_GAP = rf"[\s,.()\[\]{{}}<>-]*+(?:{_DOT_SAID}[\s,.()\[\]{{}}<>-]*+)*"
_SPELLED_NEAR = re.compile(rf"{_DIGIT_WORD}(?={_GAP}(?:[0-9]|{_DIGIT_WORD}+(?![^\W\d_])))|[0-9](?=(?=[^0-9]){_GAP}{_DIGIT_WORD}+(?![^\W\d_]))")
_PLUS = re.compile(rf"(?i)\b(?:{'|'.join(_PLUS_NAMES)})\s+(?=[0-9])|(?<=\+)\s+(?=[0-9])")
_OPEN, _CLOSE = r"[\[({<]\s{0,3}", r"\s{0,3}[\])}>]"
_AT = re.compile(rf"(?i)\s{{0,3}}{_OPEN}(?:{_AT_SAID}|@){_CLOSE}\s{{0,3}}| +{_AT_SAID} +")
_DOT = re.compile(rf"(?i)\s{{0,3}}{_OPEN}(?:{_DOT_SAID}|\.){_CLOSE}\s{{0,3}}| +{_DOT_SAID} +")
_PART = r"[A-Za-z0-9_%+-]{1,64}"
_DOT_ALT = rf"(?:\.|\s{{0,3}}{_OPEN}(?:{_DOT_SAID}|\.){_CLOSE}\s{{0,3}}| +{_DOT_SAID} +)"
_AT_HARD = rf"(?:@|\s{{0,3}}{_OPEN}(?:{_AT_SAID}|@){_CLOSE}\s{{0,3}})"
_DISGUISED = re.compile(
    rf"(?i)(?<![A-Za-z0-9_%+-]){_PART}(?:{_DOT_ALT}{_PART}){{0,4}}(?:{_AT_HARD}[A-Za-z0-9-]{{1,64}}(?:{_DOT_ALT}[A-Za-z0-9-]{{1,64}}){{1,5}}"
    rf"| +{_AT_SAID} +[A-Za-z0-9-]{{1,64}}(?:(?:\s{{0,3}}{_OPEN}(?:{_DOT_SAID}|\.){_CLOSE}\s{{0,3}}| +{_DOT_SAID} +)[A-Za-z0-9-]{{1,64}}){{1,5}})"
)
# What an address is made of: signs, plain or disguised, and the parts between them.
_ADDRESS_TOKEN = re.compile(
    rf"(?i)(?P<at>@|\s{{0,3}}{_OPEN}(?:{_AT_SAID}|@){_CLOSE}\s{{0,3}})|(?P<say_at>(?<! ) +{_AT_SAID} +)|(?P<plain_dot>\.)"
    rf"|(?P<dot>\s{{0,3}}{_OPEN}(?:{_DOT_SAID}|\.){_CLOSE}\s{{0,3}}|(?<! ) +{_DOT_SAID} +)|(?P<part>[A-Za-z0-9_%+-]+)"
)
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_EMAIL_SIGN = re.compile(rf"(?i){_OPEN}(?:{_AT_SAID}|@|{_DOT_SAID}|\.){_CLOSE}| {_DOT_SAID} ")
_IP_SIGN = re.compile(rf"(?i)[0-9](?:\s{{0,3}}{_OPEN}(?:{_DOT_SAID}|\.){_CLOSE}\s{{0,3}}| +{_DOT_SAID} +)(?=[0-9])")


def _may_spell(text: str) -> bool:
    """Whether digits are spelled beside other digits; a superset of what `_plain_digits` rewrites."""
    low = text.lower()
    return any(not (m.start() and low[m.start() - 1].isalpha()) or m[0].isdigit() for m in _SPELLED_NEAR.finditer(low))


class Rewritten:
    """A text with, for each of its characters, the source span that it stands for."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.starts: list[int] | range = range(len(text))
        self.ends: list[int] | range = range(1, len(text) + 1)

    def replace(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Applies non-overlapping, ordered edits (start, end, new); new text stands for all of its old."""
        if not edits:
            return self
        out, starts, ends, last = [], [], [], 0
        for start, end, new in edits:
            out.append(self.text[last:start])
            starts.extend(self.starts[last:start])
            ends.extend(self.ends[last:start])
            if new and end > start:
                out.append(new)
                starts.extend([self.starts[start]] * len(new))
                ends.extend([self.ends[end - 1]] * len(new))
            last = end
        out.append(self.text[last:])
        starts.extend(self.starts[last:])
        ends.extend(self.ends[last:])
        made = Rewritten("")
        made.text, made.starts, made.ends = "".join(out), starts, ends
        return made

    def source(self, span: Span) -> Span:
        start, kind, end = span
        return self.starts[start], kind, self.ends[end - 1]


def _plain_homoglyphs(now: Rewritten) -> Rewritten:
    return now.replace([(m.start(), m.end(), _HOMOGLYPHS[ord(m[0])]) for m in _ODD.finditer(now.text) if ord(m[0]) in _HOMOGLYPHS])


def _plain_digits(now: Rewritten) -> Rewritten:
    """Spelled digits beside other digits become digits, however few; joints of spaces and commas go.
    Whether prose that counts is left alone is for the detectors to decide."""
    tokens = list(_DIGIT_TOKEN.finditer(now.text))
    words = [t["words"] is not None for t in tokens]
    near = [(words[k] or words[k + 1]) and _BETWEEN.fullmatch(now.text, t.end(), tokens[k + 1].start()) is not None for k, t in enumerate(tokens[:-1])]
    near = [False, *near, False]
    edits = []
    for k, t in enumerate(tokens):
        if words[k]:
            names = _ONE_WORD.findall(t[0])
            if len(names) > 1 or near[k] or near[k + 1]:
                edits.append((t.start(), t.end(), "".join(_SPELLED[w.lower()] for w in names)))
        if near[k + 1]:
            start, end = t.end(), tokens[k + 1].start()
            if end > start and _JOINT.fullmatch(now.text, start, end):
                edits.append((start, end, now.text[start:end].strip().strip(",").strip()))
    done = now.replace(edits)
    return done.replace([(m.start(), m.end(), "" if m[0].isspace() else "+") for m in _PLUS.finditer(done.text)]) if edits else done


def _plain_signs(now: Rewritten) -> Rewritten:
    """Disguised @ and dots, inside what reads as an address as a whole: parts joined by dots, an at,
    labels joined by dots, however many. After a spoken at, the first dot has to be disguised too."""
    tokens = list(_ADDRESS_TOKEN.finditer(now.text))
    kinds = [t.lastgroup for t in tokens]

    def joined(k: int, *wanted: str) -> bool:
        """Token k is of a wanted kind and begins where the one before ends."""
        return 0 < k < len(tokens) and kinds[k] in wanted and tokens[k - 1].end() == tokens[k].start()

    edits: list[tuple[int, int, str]] = []
    used = -1  # the last token of the last address
    for k, kind in enumerate(kinds):
        if kind not in ("at", "say_at") or k - 1 <= used or not joined(k, kind) or kinds[k - 1] != "part":
            continue
        first = k - 1
        while first - 2 > used and joined(first, "part") and joined(first - 1, "dot", "plain_dot") and kinds[first - 2] == "part":
            first -= 2
        last, dots = k + 1, ("dot",) if kind == "say_at" else ("dot", "plain_dot")
        if not joined(last, "part"):
            continue
        while _LABEL.fullmatch(tokens[last][0]) and joined(last + 1, *dots) and joined(last + 2, "part") and _LABEL.match(tokens[last + 2][0]):
            last, dots = last + 2, ("dot", "plain_dot")
        if last > k + 1:
            used = last
            edits += [(tokens[j].start(), tokens[j].end(), "." if kinds[j] == "dot" else "@") for j in range(first, last) if kinds[j] in ("dot", "at", "say_at")]
    now = now.replace(edits)
    return now.replace([(x.start() + 1, x.end(), ".") for x in _IP_SIGN.finditer(now.text)])


def _plain_names(now: Rewritten) -> Rewritten:
    """As above for mailboxes and labels that are called at or dot, which tokens take for signs."""
    edits = []
    for m in _DISGUISED.finditer(now.text):
        inner = [(x.start(), x.end(), "@") for x in _AT.finditer(now.text, m.start(), m.end())]
        inner += [(x.start(), x.end(), ".") for x in _DOT.finditer(now.text, m.start(), m.end())]
        edits += sorted(inner)
    now = now.replace(edits)
    return now.replace([(x.start() + 1, x.end(), ".") for x in _IP_SIGN.finditer(now.text)])


def additions(base: list[Span], found: list[Span]) -> list[Span]:
    """The found spans that no base span and no wider found span of their kind contains, in one sweep."""
    reach, kept = [0] * len(KINDS), []
    marked = [(start, -end, False, kind) for start, kind, end in base] + [(start, -end, True, kind) for start, kind, end in found]
    for start, end, new, kind in sorted(marked):
        if new and -end > reach[kind]:
            kept.append((start, kind, -end))
        reach[kind] = max(reach[kind], -end)
    return sorted(kept)


def spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base, added) spans of a text, by start and kind."""
    text = text or ""
    base = detect(text)
    given = Rewritten(text)
    odd = not text.isascii() and _ODD.search(text) is not None
    plain = _plain_homoglyphs(given) if odd else given
    forms = [plain]
    if _may_spell(plain.text):
        forms.append(_plain_digits(plain))
    forms += [signs(form) for form in forms if _EMAIL_SIGN.search(form.text) for signs in (_plain_signs, _plain_names)]
    changed = {id(form): form for form in forms if form is not given}
    return base, additions(base, [form.source(s) for form in changed.values() for s in detect(form.text)])


def written(found: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def masked(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans as one."""
    if text is None:
        return None
    base, added = spans(text)
    out, last = [], 0
    for start, kind, end in sorted(base + added):
        if start >= last:
            out += [text[last:start], f"[{KINDS[kind].upper()}]"]
        last = max(last, end)
    return "".join([*out, text[last:]])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, counts of base spans by kind, base_sha256, spans, n_added."""
    given = narrow(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, lists, extra = [], [], []
            for text in batch.column(1):
                base, added = spans(text.as_py())
                by = Counter(kind for _, kind, _ in base)
                for k, column in enumerate(counts):
                    column.append(by[k])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                lists.append(written(sorted(base + added)))
                extra.append(len(added))
            arrays = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(lists, pa.string()), pa.array(extra, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input with all found spans of its text replaced; other columns stay as they are."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def replaced(texts):
        return texts.map(masked)

    return docs.withColumn(text_col, replaced(F.col(text_col).cast("string")))
