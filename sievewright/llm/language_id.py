"""Language identification by word-first backoff.

Known words score by their log frequency in each language. A word the model has not seen falls back
to its character n-grams, longest first: the first length of which an n-gram is known decides. The
model is fitted on a sample of labelled rows whose bound for each language is a parameter; all labels
are learned, and every word that the sample holds ``LEAST`` times in a language. Prediction reads every
whole text, map-only.

Words and n-grams are kept sparsely: only the languages that have one are listed for it, so the model
grows with what the sample holds and not with that times the number of languages.

A word is a letter (Unicode category L) with the letters and marks that follow it. White-space
delimited chunks are scored once each and kept in a table, so that a text costs one look-up a chunk.

Defined results: a null text, and one without letters (digits, fractions, signs), is `und` with score
0, and so is every text where no labelled rows exist; equal scores go to the language that sorts
first; repeated rows get the same result; texts of any length are read whole; an empty table gives
an empty result. Other columns play no part, and a null id belongs to the fold that its empty text
gives it.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.common import held_out, narrow

LONGEST = 5
SAMPLE_DOCS = 3000  #: labelled rows of a language, at most about so many
LEAST = 2  #: how often the sample of a language holds a word that is learned
FULL = 20_000_000  #: numbers up to which a task lays a table out in full, for speed; the scores are the same
SMOOTHING = 0.5
UNKNOWN = "und"
CHUNKS, CHUNK_BYTES = 400_000, 64  #: chunks that a worker keeps, and the longest that it keeps

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall


def words_of(text: str) -> list[str]:
    """The lower-cased words of a text."""
    return _WORD(text.lower())


def grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[k : k + n] for k in range(len(padded) - n + 1)]


def training_sample(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled rows outside the held-out fold, thinned by a hash of id and text to the bound."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row a language
    many = {lang: n for lang, n in counts.items() if n > per_language}
    keep = F.lit(True)
    if many:
        rates = F.create_map(*[F.lit(x) for lang, n in many.items() for x in (lang, per_language / n)])
        keep = place < F.coalesce(F.try_element_at(rates, F.col("lang")), F.lit(1.0))
    return labelled.filter(keep)


def word_counts(sample: DataFrame, least: int = LEAST) -> dict[str, Counter]:
    """How often each language has each word that it has ``least`` times. Counting is distributed; what
    comes to the driver is bounded by the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found[lang].update(words_of(text.as_py()))
        for lang, counter in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counter)), pa.array(list(counter)), pa.array(list(counter.values()), pa.int64())], names=["lang", "word", "n"])

    partial = sample.select("lang", "text").mapInArrow(run, "lang string, word string, n long")
    total = partial.groupBy("lang", "word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toArrow()
    out: dict[str, Counter] = defaultdict(Counter)
    for lang, word, n in zip(*(total[c].to_pylist() for c in ("lang", "word", "n")), strict=True):
        out[lang][word] = n
    return out


class Logs:
    """Log frequencies of keys by language: one for keys that a language has not, and for each key what the
    languages that have it have more. Where they are few numbers, they are also laid out in full."""

    def __init__(self, counts: list[Counter]) -> None:
        names = sorted(set().union(*counts)) if counts else []
        self.place = dict(zip(names, range(len(names)), strict=True))
        self.unknown = np.array([np.log(SMOOTHING) - np.log(sum(c.values()) + SMOOTHING * max(1, len(names))) for c in counts])
        key = np.array([self.place[x] for c in counts for x in c], np.int64)
        language = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
        more = np.log(np.array([n for c in counts for n in c.values()], float) + SMOOTHING) - np.log(SMOOTHING)
        order = np.argsort(key, kind="stable")
        self.language, self.more = language[order].astype(np.int32), more[order].astype(np.float32)
        self.starts = np.searchsorted(key[order], np.arange(len(names) + 1))
        self.full = None

    def lay_out(self) -> None:
        if self.full is None and len(self.place) * len(self.unknown) <= FULL:
            self.full = np.repeat(self.unknown[None].astype(np.float32), len(self.place), axis=0)
            self.full[np.repeat(np.arange(len(self.place)), np.diff(self.starts)), self.language] += self.more

    def mean(self, keys: list[str]) -> np.ndarray | None:
        """The mean row of those keys that are known, or None where none is."""
        at = [k for x in keys if (k := self.place.get(x)) is not None]
        if not at:
            return None
        if self.full is not None:
            return self.full[at[0]] if len(at) == 1 else self.full[at].sum(axis=0) / len(at)
        some = np.concatenate([np.arange(self.starts[k], self.starts[k + 1]) for k in at])
        return self.unknown + np.bincount(self.language[some], self.more[some], len(self.unknown)) / len(at)


class Model:
    """Log frequencies of words, and of n-grams of each length, by language."""

    def __init__(self, counts: dict[str, Counter]) -> None:
        self.languages = sorted(counts)
        self.words = Logs([counts[lang] for lang in self.languages])
        self.grams = {}
        for n in range(1, LONGEST + 1):
            by = [Counter() for _ in self.languages]
            for held, lang in zip(by, self.languages, strict=True):
                for word, k in counts[lang].items():
                    for g in grams(word, n):
                        held[g] += k
            self.grams[n] = Logs(by)

    def score(self, word: str) -> np.ndarray:
        row = self.words.mean([word])
        for n in range(LONGEST, 0, -1):
            if row is None and (parts := grams(word, n)):
                row = self.grams[n].mean(parts)
        return np.zeros(len(self.languages)) if row is None else row


class Scorer(dict):
    """Scores of texts, by the places of their chunks in a table: the sum of a chunk's word scores by
    language, and how many words it has. A chunk of one word has its word's place. Once the table is
    full, and for overlong chunks, a place lasts for one text."""

    def __init__(self, model: Model, most: int = CHUNKS) -> None:
        super().__init__()
        self.model, self.most = model, most
        for logs in (model.words, *model.grams.values()):
            logs.lay_out()
        self.words: dict[str, int] = {}
        self.none = 0  #: the row of chunks without words
        self.kept = self.used = 1  #: rows that stay, and rows in use
        self.full = self.kept + most
        self.table = np.zeros((4096, len(model.languages) + 1), np.float32)

    def _row(self, values: np.ndarray, words: int, keep: bool) -> int:
        k = self.used
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[k, :-1] = values
        self.table[k, -1] = words
        self.used = k + 1
        if keep and k == self.kept < self.full:
            self.kept = k + 1
        return k

    def _word(self, word: str) -> int:
        k = self.words.get(word)
        if k is None:
            k = self._row(self.model.score(word), 1, len(word) <= CHUNK_BYTES)
            if k < self.kept:
                self.words[word] = k
        return k

    def __missing__(self, chunk: bytes) -> int:
        if chunk.isalpha():
            k = self._word(chunk.lower().decode())
        elif chunk[:-1].isalpha() and chunk[-1] < 128:
            k = self._word(chunk[:-1].lower().decode())
        else:
            said = words_of(chunk.decode())
            if len(said) == 1:
                k = self._word(said[0])
            elif not said:
                k = self.none
            else:
                places = [self._word(word) for word in said]
                k = self._row(self.table[places, :-1].sum(axis=0), len(said), len(chunk) <= CHUNK_BYTES)
        if k < self.kept and len(self) < self.most and len(chunk) <= CHUNK_BYTES:
            self[chunk] = k
        return k

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.model.languages:
            return UNKNOWN, 0.0
        chunks = text.encode().split()
        places = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
        total = self.table[places].sum(axis=0, dtype=np.float64)
        self.used = self.kept
        if not total[-1]:
            return UNKNOWN, 0.0
        shifted = np.exp(np.maximum(total[:-1] - total[:-1].max(), -700.0))
        best = int(np.argmax(shifted))
        return self.model.languages[best], float(shifted[best] / shifted.sum())


_SCORERS: dict[int, Scorer] = {}


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_DOCS, least: int = LEAST) -> Model:
    given = narrow(docs, doc_id=id_col, text=text_col, lang=lang_col)
    return Model(word_counts(training_sample(given, per_language), least))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score."""
    given = narrow(docs, doc_id=id_col, text=text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _SCORERS.get(id(sent.value)) or Scorer(sent.value)
        _SCORERS.clear()
        _SCORERS[id(sent.value)] = scorer
        for batch in batches:
            out = [scorer.predict(text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
