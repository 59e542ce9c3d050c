"""Packing token sequences into fixed windows by best-fit decreasing.

Each task tokenises its documents and packs them in groups of about `group_tokens` ids: documents
longer than a window are first cut into full windows; the rest go, longest first, into the open
window that they leave tightest, found in a segment tree indexed by remaining capacity. Since
documents may be cut freely, the emptiest windows of a group are then taken apart to fill the gaps
of the others, and what is left over is cut at powers of two, which need no padding. The job is
map-only: nothing is shuffled, memory is bounded by a group, and a lost task repeats alone.

Defined results: a null or empty text is the end id alone; a text may be of any length; equal
lengths are packed in input order; repeated rows are packed each on its own; an empty table gives
no pieces. Other columns of the input play no part.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.common import narrow

WINDOW = 4096
GROUP_TOKENS = 512 * WINDOW
END_ID = 2
CACHE = 120_000  #: entries, of chunks and of parts each; some 50 MB in a worker
COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """Open windows in a segment tree over their remaining capacity."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.held: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, capacity: int, name: int) -> None:
        self.held[capacity].append(name)
        node = self.leaves + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the window with the least capacity that is enough: (capacity, name)."""
        node, count = self.leaves + need, self.count
        while not count[node]:
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
            if node >= 2 * self.leaves:
                return None
        while node < self.leaves:
            node *= 2
            if not count[node]:
                node += 1
        capacity = node - self.leaves
        name = self.held[capacity].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return capacity, name


def pack(lengths: list[int], window: int = WINDOW, fill_gaps: bool = True) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that cover all ids of all documents once."""
    full: list[list[tuple[int, int, int]]] = []
    rests: list[tuple[int, int, int]] = []
    for doc, n in enumerate(lengths):
        whole = n // window
        full += [[(doc, k * window, window)] for k in range(whole)]
        if n % window:
            rests.append((doc, whole * window, n % window))
    rests.sort(key=lambda piece: -piece[2])
    windows: list[list[tuple[int, int, int]]] = []
    free: list[int] = []
    tree = OpenWindows(window)
    for piece in rests:
        got = tree.tightest(piece[2])
        if got is None:
            capacity, name = window, len(windows)
            windows.append([])
            free.append(window)
        else:
            capacity, name = got
        windows[name].append(piece)
        free[name] = capacity - piece[2]
        if free[name]:
            tree.add(free[name], name)
    if fill_gaps:
        windows = _fill(windows, free, window)
    return full + windows


def _fill(windows: list[list[tuple[int, int, int]]], free: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """Takes the emptiest windows apart until their ids fill all other gaps exactly."""
    order = sorted(range(len(windows)), key=lambda k: free[k])
    gap, loose = sum(free), 0
    keep = len(order)
    while keep and loose < gap:
        keep -= 1
        gap -= free[order[keep]]
        loose += window - free[order[keep]]
    spare = [piece for k in order[keep:] for piece in windows[k]]
    done = []
    for k in order[:keep]:
        room = free[k]
        while room:
            doc, start, n = spare.pop()
            part = min(n, room)
            windows[k].append((doc, start, part))
            room -= part
            if n > part:
                spare.append((doc, start + part, n - part))
        done.append(windows[k])
    left = sum(n for _, _, n in spare)
    while left:
        size = window if left >= window else 1 << (left.bit_length() - 1)
        left -= size
        made = []
        while size:
            doc, start, n = spare.pop()
            part = min(n, size)
            made.append((doc, start, part))
            size -= part
            if n > part:
                spare.append((doc, start + part, n - part))
        done.append(made)
    return done


class WordIds(dict):
    """Ids (little-endian, 4 bytes each) of white-space-delimited chunks of UTF-8.

    The tokenizer drops white space and merges nothing across it, so chunks can be encoded one by
    one. Latin chunks are split as the tokenizer's own pattern splits them and go to its BPE model;
    all others, and those that may hold a special token, go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.parts: dict[str, bytes] = {}
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}

    def __missing__(self, chunk: bytes) -> bytes:
        if chunk.isalpha():
            ids = self.part(chunk.decode().lower())
        elif chunk[:-1].isalpha() and 32 < chunk[-1] < 127:
            ids = self.part(chunk[:-1].decode().lower()) + self.part(chunk[-1:].decode())
        else:
            text = chunk.decode()
            if min(text) > " " and max(text) < "ɐ" and "İ" not in text and "<|" not in text:
                ids = b"".join([self.part(p) for p in self.split(text.lower())])
            else:
                ids = array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) < CACHE:
            self[chunk] = ids
        return ids

    def part(self, text: str) -> bytes:
        ids = self.parts.get(text)
        if ids is None:
            shown = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            if len(self.parts) < CACHE:
                self.parts[text] = ids
        return ids

    def forget(self) -> None:
        """Empties the caches, so that an idle worker holds the tokenizer alone."""
        self.clear()
        self.parts.clear()
        pa.default_memory_pool().release_unused()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split()))


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One tokenizer for each Python worker; its caches last for a task."""
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str = "word_bpe_49k.json", window: int = WINDOW, group_tokens: int = GROUP_TOKENS, end_id: int = END_ID, fill_gaps: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = narrow(docs, doc_id=id_col, text=text_col)
    end = array("I", [end_id]).tobytes()

    def packed(names: list, ids: list[bytes], base: int) -> tuple[pa.RecordBatch, int]:
        sequences = pack([len(x) // 4 for x in ids], window, fill_gaps)
        doc, start, length, crc, total, sequence, offset = [], [], [], [], [], [], []
        for k, sequence_pieces in enumerate(sequences):
            at = 0
            for d, s, n in sequence_pieces:
                doc.append(names[d])
                start.append(s)
                length.append(n)
                crc.append(zlib.crc32(ids[d][4 * s : 4 * (s + n)]))
                total.append(len(ids[d]) // 4)
                sequence.append(base + k)
                offset.append(at)
                at += n
        numbers = [pa.array(x, pa.int64()) for x in (start, length, crc, total, sequence, offset)]
        return pa.RecordBatch.from_arrays([pa.array(doc, id_type), *numbers], names=["doc_id", *[c.split()[0] for c in COLUMNS.split(", ")]]), len(sequences)

    id_name = rows.schema["doc_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(rows.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path(tokenizer))
        encode = words.encode
        base = TaskContext.get().partitionId() << 36
        names, ids, held = [], [], 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                one = encode(text.as_py() or "") + end
                names.append(name)
                ids.append(one)
                held += len(one) // 4
                if held >= group_tokens:
                    out, used = packed(names, ids, base)
                    base += used
                    names, ids, held = [], [], 0
                    yield out
        if ids:
            yield packed(names, ids, base)[0]
        words.forget()

    return rows.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {id_name}, {COLUMNS}")
