"""De-identification: ordered rules, then amounts to ranges."""

from __future__ import annotations

import bisect
import functools
import re

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from sievewright.functions.text import let

VERSION = "rules-1"

# Rules in order of application, as (kind, pattern, placeholder). A pattern with a
# group masks the group only.
RULES = (
    ("email", r"[\w.+-]+@[\w-]+\.[\w.-]+", "[EMAIL]"),
    ("url", r"https?://[^\s，。、）)]+", "[URL]"),
    ("national_id", r"(?<![A-Za-z0-9])[A-Za-z][12]\d{8}(?![0-9])", "[身分證]"),
    ("cvs_code", r"(?:超商代碼|繳費代碼|條碼|代碼)\s*[:：]?\s*([A-Za-z0-9]{10,16})", "[超商代碼]"),
    ("credit_card", r"(?<!\d)(?:\d{4}[-\s]?){3}\d{4}(?!\d)", "[卡號]"),
    ("mobile", r"(?<!\d)09\d{2}[-\s]?\d{3}[-\s]?\d{3}(?!\d)", "[手機]"),
    ("landline", r"(?<!\d)0\d{1,2}[-\s]?\d{6,8}(?!\d)", "[電話]"),
    ("bank_account", r"(?:帳號|匯[到入至]|轉[到入至]|戶號)\s*[:：]?\s*(\d[\d\- ]{8,20}\d)", "[帳號]"),
    ("bare_account", r"(?<!\d)\d{10,16}(?!\d)", "[帳號]"),
    ("line_id", r"(?:LINE|line|賴|加賴)\s*(?:ID|id|帳號)?\s*[:：]\s*([A-Za-z0-9_.-]{3,30})", "[通訊帳號]"),
    ("person", r"(?:我叫|我是|姓名是|本人|收款人|匯款人|對方叫|自稱)\s*([一-鿿]{2,4})(?=[，。、\s]|$)", "[姓名]"),
    ("address", r"[一-鿿]{2,3}[市縣][一-鿿]{1,3}[區鄉鎮市][一-鿿0-9]{2,12}[路街道][^\s，。]{0,12}號", "[地址]"),
)
AMOUNT = r"(?<![\d,])((?:\d{1,3}(?:,\d{3})+|\d{4,12}))\s*(?:元|塊|NTD?|台幣)?"
AMOUNT_CN = r"(\d+(?:\.\d+)?)\s*(萬|億)\s*(?:元|塊)?"
BUCKETS = ((10_000, "1 萬以下"), (50_000, "1 萬到 5 萬"), (100_000, "5 萬到 10 萬"), (500_000, "10 萬到 50 萬"), (1_000_000, "50 萬到 100 萬"), (5_000_000, "100 萬到 500 萬"))
TOP_BUCKET = "500 萬以上"
# What marks a number as a year or date: after it, within AFTER_CHARS characters, and before it.
YEAR_AFTER = r"\s*(?:年|[/\-.]\s*\d{1,2})"
AFTER_CHARS = 4
ERAS = ("民國", "民国", "西元", "西曆", "西历")
# End of fixed values.

#: Digit runs that are too long for the account rule would leak their tail; they are masked whole.
LONG_RUN = ("long_account", r"(?<!\d)\d{17,}(?!\d)", "[帳號]")

#: Forms of rules with the same matches that never go over a run of characters twice: a run that can't
#: match from its beginning can't match from within, except where the match before ended in it (\G).
LINEAR = {
    "email": r"(?:\G|(?<![\w.+-]))[\w.+-]++@[\w-]+\.[\w.-]+",
    "cvs_code": r"(?:超商代碼|繳費代碼|條碼|代碼)\s*+(?:[:：]\s*+)?([A-Za-z0-9]{10,16})",
    "bank_account": r"(?:帳號|匯[到入至]|轉[到入至]|戶號)\s*+(?:[:：]\s*+)?(\d[\d\- ]{8,20}\d)",
    "line_id": r"(?:LINE|line|賴|加賴)\s*+(?:(?:ID|id|帳號)\s*+)?[:：]\s*+([A-Za-z0-9_.-]{3,30})",
    "person": r"(?:我叫|我是|姓名是|本人|收款人|匯款人|對方叫|自稱)\s*+([一-鿿]{2,4})(?=[，。、\s]|$)",
}
LINEAR_AMOUNT_CN = r"(?<!\d)(\d++(?:\.\d++)?)\s*+(萬|億)\s*(?:元|塊)?"
#: What a text must hold for a rule to find anything; placeholders hold none of it.
WEB, DIGITS, WORDS = "@|://", r"\d{4}", r"[一-鿿]|(?:LINE|line)\s*+(?:(?:ID|id)\s*+)?[:：]"
NEEDS = {"email": WEB, "url": WEB, "cvs_code": WORDS, "bank_account": WORDS, "line_id": WORDS, "person": WORDS, "address": WORDS}
_YEAR_AFTER = re.compile(YEAR_AFTER)
#: Grouped rules whose group can also occur in the words before it, where it is masked too.
REPEATS = ("line_id", "person")
_FROM, _THEN, _TO = "\ufdd0\ufdd1\ufdd2"  # no characters of any text


def amount_bucket(value: Column) -> Column:
    out = F.lit(TOP_BUCKET)
    for ceiling, name in reversed(BUCKETS):
        out = F.when(value < ceiling, name).otherwise(out)
    return out


def _chain(c: Column, rules) -> Column:
    for kind, given, placeholder in rules:
        pattern = LINEAR.get(kind, given)
        grouped = re.search(r"\((?!\?)", pattern)
        if grouped:
            before, rest = pattern[: grouped.start()], pattern[grouped.start() :]
            if kind in REPEATS:  # marks set the match apart: what leads up to the group, and the group
                c = F.regexp_replace(c, f"(?U)({before}){rest}", f"{_FROM}$1{_THEN}$2{_TO}")
                c = F.regexp_replace(c, f"{_FROM}(?=[^{_THEN}]*{_THEN}([^{_TO}]*){_TO})([^{_THEN}]*?)\\1([^{_THEN}]*){_THEN}\\1{_TO}", f"$2{placeholder}$3{placeholder}")
                c = F.regexp_replace(c, f"{_FROM}([^{_THEN}]*){_THEN}[^{_TO}]*{_TO}", f"$1{placeholder}")
            else:
                c = F.regexp_replace(c, f"(?U)({before}){rest}", f"$1{placeholder}")
        else:
            c = F.regexp_replace(c, f"(?U){pattern}", placeholder)
    return c


def mask_native(c: Column, rules=(*RULES, LONG_RUN)) -> Column:
    """Text with all identifiers replaced, inside the JVM; amounts are left alone. A text only passes the
    rules for which it holds what they need."""
    needs = (WEB, DIGITS, WORDS)
    held = sum((F.when(c.rlike(f"(?U){need}"), 1 << bit).otherwise(0) for bit, need in enumerate(needs)), F.lit(0))

    def masked(bits: Column) -> Column:
        out = F.when(bits == 0, c)
        for mask in range(1, 1 << len(needs)):
            some = [need for bit, need in enumerate(needs) if mask >> bit & 1]
            out = out.when(bits == mask, _chain(c, [r for r in rules if NEEDS.get(r[0], DIGITS) in some]))
        return out

    return let(held, masked)


def found_kinds(c: Column) -> Column:
    """Kinds of identifiers in a text, each rule seeing what the earlier ones left. An account is one,
    whether a word before it says so or not."""
    kind = lambda r: F.when(r["kind"].isin("bare_account", LONG_RUN[0]), "bank_account").otherwise(r["kind"])
    return F.array_distinct(F.transform(mask_struct(c)["redactions"], kind))


def recall(found: Column, expected: Column) -> Column:
    """The share of the different expected kinds that were found; 1 where none are expected."""
    wanted = F.array_distinct(expected)
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, found)) / F.size(wanted)).otherwise(1.0)


def _bucket(value: float) -> str:
    return next((name for ceiling, name in BUCKETS if value < ceiling), TOP_BUCKET)


def _is_date(text: str, m: re.Match) -> bool:
    """Whether an amount without thousands separators reads as a year or a date."""
    if "," in m[1]:
        return False
    end = m.start()
    while end and text[end - 1].isspace():
        end -= 1
    return text[max(0, end - 2) : end] in ERAS or _YEAR_AFTER.match(text[m.end() : m.end() + AFTER_CHARS]) is not None


class Traced:
    """A text under rewriting that knows where its characters come from: pieces (first character, first and
    last place in the source, whether they are the source's own characters)."""

    def __init__(self, text: str) -> None:
        self.text, self.pieces, self.starts = text, [(0, 0, len(text), True)], [0]

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The span of the source that a span, not an empty one, stands for."""
        at, first, last, own = self.pieces[bisect.bisect_right(self.starts, start) - 1]
        low = first + start - at if own else first
        at, first, last, own = self.pieces[bisect.bisect_left(self.starts, end) - 1]
        return low, first + end - at if own else last

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Applies ordered edits (start, end, new) that don't overlap."""
        if not edits:
            return
        out, pieces, size, last = [], [], 0, 0

        def keep(start: int, end: int) -> None:
            nonlocal size
            k = bisect.bisect_right(self.starts, start) - 1
            while start < end:
                at, first, close, own = self.pieces[k]
                stop = min(end, self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text))
                pieces.append((size, first + start - at, first + stop - at, True) if own else (size, first, close, False))
                size += stop - start
                start, k = stop, k + 1

        for start, end, new in edits:
            keep(last, start)
            low, high = self.source(start, end)
            pieces.append((size, low, high, False))
            size += len(new)
            out += [self.text[last:start], new]
            last = end
        keep(last, len(self.text))
        out.append(self.text[last:])
        self.text, self.pieces = "".join(out), pieces
        self.starts = [p[0] for p in pieces]


@functools.cache
def _compiled(kind: str, pattern: str):
    return regex.compile(LINEAR[kind]) if kind == "email" else re.compile(LINEAR.get(kind, pattern))


def mask_text(text: str | None, rules=(*RULES, LONG_RUN)) -> tuple[str, list[tuple[str, int, int, str, int, int]]]:
    """(masked text, redactions); a redaction's first offsets are those of the whole match, in the text as
    its rule finds it, also where only the group is masked; its last ones are the source's span of what
    was masked. A group is masked wherever it occurs in its match."""
    now, found = Traced(text or ""), []
    holds = {need: re.search(need, now.text) is not None for need in (WEB, DIGITS, WORDS)}
    for kind, given, placeholder in rules:
        if not holds[NEEDS.get(kind, DIGITS)]:
            continue
        pattern, edits = _compiled(kind, given), []
        for m in pattern.finditer(now.text):
            group = pattern.groups
            found.append((kind, m.start(), m.end(), placeholder, *now.source(m.start(group), m.end(group))))
            place = m.start()
            while (place := now.text.find(m[group], place, m.end())) >= 0:
                edits.append((place, place + len(m[group]), placeholder))
                place += len(m[group])
        now.replace(edits)
    for pattern, value in ((LINEAR_AMOUNT_CN, lambda m: float(m[1]) * (1e4 if m[2] == "萬" else 1e8)), (AMOUNT, lambda m: float(m[1].replace(",", "")))):
        edits = [(m.start(), m.end(), _bucket(value(m))) for m in re.finditer(pattern, now.text) if pattern != AMOUNT or not _is_date(now.text, m)]
        found += [("amount", start, end, new, *now.source(start, end)) for start, end, new in edits]
        now.replace(edits)
    return now.text, found


REDACTION = ("kind", "start", "end", "placeholder", "source_start", "source_end")


@functools.cache
def _struct_udf():
    """Made on first use: its type is a struct, which needs a session to be written as text."""
    import pandas as pd

    def run(s):
        rows = [mask_text(x) for x in s]
        return pd.DataFrame({"text": [t for t, _ in rows], "redactions": [[dict(zip(REDACTION, x, strict=True)) for x in r] for _, r in rows], "deid_version": VERSION})

    return F.pandas_udf(run, "text string, redactions array<struct<kind:string,start:int,end:int,placeholder:string,source_start:int,source_end:int>>, deid_version string")


def mask_struct(c: Column) -> Column:
    """Struct of masked text, redactions and version; sinks for masked data ask for its version."""
    return _struct_udf()(c)
