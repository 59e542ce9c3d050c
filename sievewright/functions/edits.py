"""Edit distance of texts of any length and script, in Arrow batches.

Most texts differ in few places far from each other. There an alignment is found by following the texts
and trying few edits where they part, and its number of edits is the distance if no alignment has fewer.
That is proved by disjoint pieces of the first text: one that occurs nowhere in the reach of such an
alignment costs an edit, and a longer one what its best place costs.

Where there is no such proof, the distance table is computed. Its columns are kept as bit vectors
(differences of neighbouring cells), one for a character of the second text. Only a band about the diagonal
is kept, of so many rows that every path of few enough edits lies within it; where no alignment is known
and the distance found is larger, the band grows fourfold. Time is in proportion to length times distance / 64,
memory to the band.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

FIRST_REACH = 32
STEP = 64  #: characters compared at once
SURE = 8  #: so many equal characters end a place of edits
MOST = 24  #: edits tried at once at one place
BESIDE = 24  #: characters beside a place that go into its piece
LEAST_PIECE = 4  #: shorter pieces occur in too many places to be looked for
SHORT = 24  #: the table of texts up to this length is made at once
PIECE = 64  #: characters of a piece that are looked for first
LONGER = (0, 1, 1, 1, 1, 2, 2, 4, 4, 8)  #: a piece that occurs elsewhere grows by so many characters
WHOLE = (0, 8)  #: the steps at which all of it is looked for
WORK = 3  #: cells searched for an alignment, and columns for its proof, at most, for each character
EDGE = "\0"  #: put at both ends of both texts, which changes no distance, so that pieces at an end are told from others


def _shared(a: str, b: str, at_end: bool) -> int:
    """Length of the longest common prefix, or suffix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        same = a[len(a) - middle : len(a) - low] == b[len(b) - middle : len(b) - low] if at_end else a[low:middle] == b[low:middle]
        low, high = (middle, high) if same else (low, middle - 1)
    return low


class _Texts:
    """Two texts and their characters as numbers of equal width."""

    def __init__(self, a: str, b: str) -> None:
        self.a, self.b = a, b
        try:
            self.codes, self.others, self.width = a.encode("latin-1"), b.encode("latin-1"), 1
        except UnicodeEncodeError:
            self.codes, self.others, self.width = a.encode("utf-32-le", "surrogatepass"), b.encode("utf-32-le", "surrogatepass"), 4

    def run(self, i: int, j: int) -> int:
        """How many characters from places i and j on are equal."""
        width, step = self.width, STEP * self.width
        at, other, n = i * width, j * width, 0
        while True:
            left, right = self.codes[at : at + step], self.others[other : other + step]
            if left != right:
                size = min(len(left), len(right))
                apart = int.from_bytes(left[:size], "little") ^ int.from_bytes(right[:size], "little")
                return (n + (((apart & -apart).bit_length() - 1) // 8 if apart else size)) // width
            if len(left) < step:
                return (n + len(left)) // width
            at, other, n = at + step, other + step, n + step

    def part(self, i: int, j: int) -> tuple[int, int, int, int]:
        """Where the texts meet again that part at i and j, by the fewest edits: edits, the places, and how many
        cells of the search that took. After MOST edits, how far those lead at most."""
        a, b, next_a = self.a, self.b, self.a[i + 1 : i + 1 + SURE]
        if i == len(a) or j == len(b):
            return len(a) - i + len(b) - j, len(a), len(b), 0
        if next_a == b[j + 1 : j + 1 + SURE]:
            return 1, i + 1, j + 1, 0
        if next_a == b[j : j + SURE]:
            return 1, i + 1, j, 0
        if a[i : i + SURE] == b[j + 1 : j + 1 + SURE]:
            return 1, i, j + 1, 0
        rows, columns, front = len(a), len(b), [i]  # the last row reached on each diagonal
        for edits in range(1, MOST + 1):
            before, front, met = [-9, -9, *front, -9, -9], [], []
            for k in range(2 * edits + 1):
                row, across = max(before[k], before[k + 1] + 1, before[k + 2] + 1), j - i + k - edits
                column = row + across
                if row < i or column < j or row > rows or column > columns:
                    front.append(-9)
                    continue
                reached, last = row, row + min(SURE, rows - row, columns - column)
                while reached < last and a[reached] == b[reached + across]:
                    reached += 1
                front.append(reached)
                if reached - row == SURE or reached == rows and reached + across == columns:
                    met.append((row, column))
            if met:
                row, column = met[0] if len(met) == 1 else max(met, key=lambda at: at[0] + self.run(*at))
                return edits, row, column, (edits + 1) ** 2
        row, column = max(((row, row + j - i + k - MOST) for k, row in enumerate(front) if row >= 0), key=sum)
        return MOST, row, column, (MOST + 1) ** 2

    def places(self) -> list[tuple[int, int, int]] | None:
        """An alignment: where in the first text it has edits, from, to and how many; None where they are dense."""
        found, cells = [], WORK * len(self.a)
        i = j = self.run(0, 0)
        while i < len(self.a) or j < len(self.b):
            met = self.part(i, j)
            if (cells := cells - met[3]) < 0:
                return None
            found.append((i, met[1], met[0]))
            i, j = met[1], met[2]
            same = self.run(i, j)
            i, j = i + same, j + same
        return found

    def proved(self, places: list[tuple[int, int, int]], bound: int) -> bool:
        """Whether every alignment of at most ``bound`` edits has just that number.

        Such an alignment keeps to diagonals from which the last one is in reach. Pieces of the first text
        are taken from left to right, and none overlap, so their costs add up."""
        a, b, shift = self.a, self.b, len(self.b) - len(self.a)
        spare, columns = (bound - abs(shift)) // 2, WORK * len(a)
        first_low, last_high, at, known = min(0, shift) - spare, max(0, shift) + spare, 0, 0
        taken = []  # for each place: where its pieces may begin, and the edits known before them
        for place, (start, end, edits) in enumerate(places):
            low, high = max(first_low, shift - bound + known), min(last_high, shift + bound - known)
            taken.append((at, known))
            stop, known = start, known + edits
            for _ in range(edits):
                stop = max(stop, at) + 1
                for more in LONGER:
                    stop += more
                    short = max(at, stop - PIECE)
                    if stop > len(a) or b.find(a[short:stop], max(0, short + low), max(0, stop + high)) < 0:
                        break
                    if at < short and more in WHOLE and b.find(a[at:stop], max(0, at + low), max(0, stop + high)) < 0:
                        break
                else:
                    break
                if stop > len(a):
                    break
                at = stop
            else:
                continue
            after = min(end + BESIDE, places[place + 1][0] if place + 1 < len(places) else len(a))
            for back in (0, 1, 3, 7):  # with so many places before it
                first = max(0, place - back)
                at, before = max(taken[first][0], places[first][0] - BESIDE * (1 + back)), taken[first][1]
                if at >= after:
                    continue
                low, high = max(first_low, shift - bound + before), min(last_high, shift + bound - before)
                piece, text = a[at:after], b[max(0, at + low) : max(0, after + high)]
                spans = near(piece, text, known - before)
                if (columns := columns - (1 + len(piece) // 256) * sum(stop - start for start, stop in spans)) < 0:
                    return False
                if all(least_within(piece, text[start:stop]) >= known - before for start, stop in spans):
                    break
            else:
                return False
            at = after
        return True


def near(a: str, text: str, edits: int) -> list[tuple[int, int]]:
    """The parts of ``text``, from and to, that may hold ``a`` with fewer than so many edits: if ``a`` is cut into as
    many pieces, one of them is left as it is."""
    size, found = len(a) // edits, []
    if size < LEAST_PIECE:
        return [(0, len(text))]
    for first in range(0, size * edits, size):
        at = text.find(a[first : first + size])
        while at >= 0:
            found.append(at - first)
            if len(found) * size > len(text):
                return [(0, len(text))]
            at = text.find(a[first : first + size], at + 1)
    spans: list[tuple[int, int]] = []
    for at in sorted(found):
        start, stop = max(0, at - edits), min(len(text), at + len(a) + edits)
        if spans and start <= spans[-1][1]:
            start = spans.pop()[0]
        spans.append((start, stop))
    return spans


def least_within(a: str, text: str) -> int:
    """The distance of ``a`` from the part of ``text`` that is nearest to it."""
    masks: dict[str, int] = {}
    for row, character in enumerate(a):
        masks[character] = masks.get(character, 0) | 1 << row
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    more, less = every, 0
    distance = least = len(a)
    for character in text:
        match = masks.get(character, 0)
        free = ((((match & more) + more) ^ more) | match | less) & every
        right_more, right_less = less | every ^ (free | more), free & more
        if right_more & last:
            distance += 1
        elif right_less & last:
            distance -= 1
            least = min(least, distance)
        down = right_more << 1
        more, less = (right_less << 1 | every ^ (free | down)) & every, down & free
    return least


def within(a: str, b: str, reach: int) -> int:
    """The least edits of a path that keeps within ``reach`` of the diagonal, for ``a`` no longer than ``b``, and at
    most ``reach`` shorter. That is the distance where it is at most twice ``reach`` less what ``b`` is longer: a path
    that strays farther has to come back.

    In column j, bit k stands for row j - reach + k. Rows above the first are all at distance j, which the
    recurrence keeps by itself; a row that enters at the bottom counts as no match until it is computed."""
    rows, width = len(a), 2 * reach + 1
    every, bottom = (1 << width) - 1, 1 << (2 * reach)
    places = {}  # character: its rows in the band as of some column, and that column
    for row in range(1, min(reach, rows) + 1):
        mask, _ = places.get(a[row - 1], (0, 1))
        places[a[row - 1]] = mask | 1 << (row - 1 + reach), 1
    more, less = every ^ ((1 << reach) - 1), 0
    distance = min(reach, rows)
    for column, character in enumerate(b, 1):
        row = column + reach
        if row <= rows:
            mask, since = places.get(a[row - 1], (0, column))
            places[a[row - 1]] = mask >> (column - since) | bottom, column
        match = 0
        if character in places:
            mask, since = places[character]
            match = mask >> (column - since)
        free = ((((match & more) + more) ^ more) | match | less) & every
        right_more, right_less = less | every ^ (free | more), free & more
        if row <= rows:
            distance += not free & bottom
        else:
            last = 1 << (rows - column + reach)
            distance += bool(right_more & last) - bool(right_less & last)
        down = free >> 1
        more, less = right_less | every ^ (down | right_more), down & right_more
    return distance


def distance(a: str, b: str) -> int:
    """Fewest insertions, deletions and substitutions of characters that make one text the other."""
    start = _shared(a, b, False)
    end = _shared(a[start:], b[start:], True)
    if start + end == min(len(a), len(b)):
        return abs(len(a) - len(b))
    if len(a) > len(b):
        a, b = b, a
    before, after = EDGE + a[max(0, start - BESIDE) : start], a[len(a) - end :][:BESIDE] + EDGE
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    longer = len(b) - len(a)
    reach = max(FIRST_REACH, longer)
    if len(b) > SHORT:
        texts = _Texts(before + a + after, before + b + after)
        if (places := texts.places()) is not None:
            bound = sum(edits for _, _, edits in places)
            if texts.proved(places, bound):
                return bound
            reach = (bound + longer + 1) // 2
    while (found := within(a, b, reach)) > 2 * reach - longer:
        reach = min(4 * reach, len(b))
    return found


@F.pandas_udf(LongType())
def _edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def edits(reference: Column, heard: Column) -> Column:
    """Edit distance of two texts; null where either is."""
    return _edits(reference, heard)
