"""Quality classification by positive-unlabelled learning with a non-negative unbiased risk.

Trusted positives (label 1) and unlabelled web text (all documents) train a small network on text
measurements. The risk of the unlabelled part, less the positives' share, is kept from going negative.
The class prior is estimated without negatives: a first network learns from half of the positives, and
the least ratio of the unlabelled to the other half's share above a cut-off is the prior (a cut-off
that few positives pass is no evidence). Labels 0 play no part: the score is the network's own
logistic share, whose loss is a proper one.

Samples are of rows, not ids: the ``POSITIVES`` labelled and ``UNLABELLED`` other rows of the least
hashes of id and text come to the driver, measured, and never more, however often an id or a text
repeats. Scoring reads every whole text, map-only. The measurements are shares of bytes, lines and
words; they tell junk from prose by form, not by what it says.

Defined results: a null or empty text is scored on its (zero) measurements; repeated rows get equal
scores, and so do ties; a label that repeats for one id counts once; without positives or unlabelled
text every score is 0.5; texts of any length are read whole; an empty table gives an empty result.
Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.common import held_out, narrow

POSITIVES, UNLABELLED = 6000, 12_000  #: rows of the samples, at most
THRESHOLD = 0.7
HIDDEN, EPOCHS, RATE = 24, 300, 0.02

_CLASS = np.zeros(256, np.int64)  #: byte class: 1 upper, 2 lower, 3 digit, 4 symbol, 5 mark, 6 stop, 7 white, 8 beyond ASCII
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&|<>@~^=_{}[]\\/", b"!?", b".,;:", b" \t\n\r\x0b\f", bytes(range(128, 256))), 1):
    _CLASS[np.frombuffer(_chars, np.uint8)] = _k


def measure(text: str | None) -> list[float]:
    """What the network sees of a text."""
    text = text or ""
    raw = text.encode()
    found = text.split()
    n, m = len(found), max(1, len(found))
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9) / max(1, len(raw))
    lines = [x for x in text.split("\n") if x.strip()]
    grams = max(1, n - 2)
    return [
        np.log1p(n), np.log1p(n) ** 2 / 10, len(raw) / m / 10, *kinds.tolist(),
        len(set(found)) / m, 1 - len(set(zip(found, found[1:], found[2:]))) / grams if n > 2 else 0.0,
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)) / 5, n / max(1, len(lines)) / 100,
        float(n < 20), max(map(len, found), default=0) / 50,
    ]


def _measured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), *batch.columns[1:]], names=["x", *batch.schema.names[1:]])

    kinds = ", ".join(f"{c} {t}" for c, t in docs.dtypes[1:])
    return docs.mapInArrow(run, "x array<double>" + (f", {kinds}" if kinds else ""))


def _place(seed: str) -> Column:
    """Where a row stands in its sample's order, from 0 to 1, by its id and text."""
    return F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def _sample(rows: DataFrame, seed: str, total: int, most: int) -> np.ndarray:
    """Measurements of the ``most`` rows of (doc_id, text) that come first. Only those before twice their share
    are measured; where copies abound, so that many rows stand at one place, they may be fewer than ``most``."""
    placed = rows.withColumn("place", _place(seed)).filter(F.col("place") < min(1.0, (2 * most + 1000) / max(1, total)))
    taken = _measured(placed.select(F.col("text").cast("string"), "place")).orderBy("place").limit(most).toPandas()
    x = np.array([*map(np.asarray, taken["x"])], float).reshape(-1, len(measure("")))
    return x[np.lexsort(x.T)] if len(x) else x  # rows may arrive in any order; the fit must not depend on it


class Model:
    """A one-hidden-layer network."""

    def __init__(self, width: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.w1 = rng.normal(0, width**-0.5, (width, HIDDEN))
        self.b1, self.w2, self.b2 = np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0
        self.prior = 0.5

    def margin(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        """The logistic share of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def pu_risk(g: np.ndarray, n_p: int, prior: float) -> tuple[float, np.ndarray]:
    """prior R_p(+) + max(0, R_u(-) - prior R_p(-))  with the logistic loss, of margins whose first ``n_p``
    are positives' and whose others are unlabelled rows'; and what training descends along: the risk's
    gradient by margin or, where the second part is negative, the way that raises it."""
    n_u = len(g) - n_p
    loss = lambda s: np.logaddexp(0, s)
    sig = 1 / (1 + np.exp(-np.clip(g, -500, 500)))
    up, down = np.zeros(len(g)), np.zeros(len(g))
    up[:n_p] = prior * (sig[:n_p] - 1) / n_p
    down[n_p:] = sig[n_p:] / n_u
    down[:n_p] = -prior * sig[:n_p] / n_p
    rest = loss(g[n_p:]).mean() - prior * loss(g[:n_p]).mean()
    return prior * loss(-g[:n_p]).mean() + max(0.0, rest), up + down if rest >= 0 else -down


def nn_pu(model: Model, pos: np.ndarray, unl: np.ndarray, prior: float, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Adam on the non-negative risk."""
    both = np.concatenate([pos, unl])
    model.mean, model.scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    names = ("w1", "b1", "w2", "b2")
    moments = {k: [np.zeros_like(np.asarray(getattr(model, k), float)) for _ in range(2)] for k in names}
    xp, xu = (np.clip((x - model.mean) / model.scale, -8, 8) for x in (pos, unl))
    x = np.concatenate([xp, xu])
    for step in range(1, epochs + 1):
        hidden = np.tanh(x @ model.w1 + model.b1)
        _, grad = pu_risk(hidden @ model.w2 + model.b2, len(xp), prior)
        gh = np.outer(grad, model.w2) * (1 - hidden**2)
        grads = {"w1": x.T @ gh + 1e-4 * model.w1, "b1": gh.sum(axis=0), "w2": hidden.T @ grad + 1e-4 * model.w2, "b2": grad.sum()}
        for k in names:
            a, b = moments[k]
            a += 0.1 * (grads[k] - a)
            b += 0.001 * (grads[k] ** 2 - b)
            setattr(model, k, getattr(model, k) - rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8))
    return model


def best_bin_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The least ratio of the unlabelled to the positive share above a cut-off bounds the prior. The
    positives are other ones than those that the scores were fitted on; only cut-offs that at least a
    fifth of them pass count."""
    cuts = np.quantile(pos, np.linspace(0.0, 0.8, 17))
    return float(min((unl >= c).mean() / (pos >= c).mean() for c in cuts))


def estimated_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The class prior from positives and unlabelled rows: the mean of two halves' estimates."""
    if len(pos) < 4:
        return 0.5
    found = []
    for k in (0, 1):
        first = nn_pu(Model(pos.shape[1]), pos[k::2], unl, 0.5, EPOCHS // 3)
        found.append(best_bin_prior(first.margin(pos[1 - k :: 2]), first.margin(unl)))
    return float(np.clip(np.mean(found), 0.05, 0.95))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fits on samples of rows outside the held-out fold."""
    given = narrow(docs, doc_id=id_col, text=text_col).filter(~held_out(F.col("doc_id")))
    good = narrow(labels, doc_id=id_col, label=label_col).filter((F.col("label") == 1) & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    counts = given.select("doc_id").join(good.withColumn("good", F.lit(1)), "doc_id", "left").agg(F.count(F.lit(1)).alias("all"), F.count("good").alias("good")).first()
    # Rows are thinned where they lie, before their texts meet the labels.
    thin = given.filter(_place("labelled") < min(1.0, (2 * positives + 1000) / max(1, counts["good"])))
    x = _sample(thin.join(good, "doc_id", "left_semi"), "labelled", counts["good"], positives)
    u = _sample(given, "unlabelled", counts["all"], unlabelled)
    model = Model(len(measure("")))
    if not len(x) or not len(u):
        model.w2 *= 0
        return model
    model.prior = estimated_prior(x, u)
    return nn_pu(model, x, u, model.prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    given = narrow(docs, doc_id=id_col, text=text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([measure(t.as_py()) for t in batch.column(2)], float)
            s = sent.value.score(x) if len(x) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
