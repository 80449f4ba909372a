"""Quality classifier: a generalised additive model with pairwise interactions.

Text statistics are binned. Boosting goes round the features in turn; each step fits a
tree of three leaves at most on one feature's gradient histogram and adds it, shrunk, to
that feature's look-up table. The pairs whose residuals gain most on a coarse grid are then
boosted likewise, with trees that split once along each axis. Scoring adds up bins.

The model is fitted on at most SAMPLE labelled rows, those with the lowest hash of their
id; everything else runs over all documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, crc_mod, fresh, one_row_per, stored, table, with_columns

SAMPLE = 20_000
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
SYMBOLS = b"#*$%&|<>"
FEATURES = (
    "log_words", "word_length", "symbols", "shouts", "capitals", "digits", "stops", "same_as_before",
    "distinct_words", "dup_lines", "line_words", "wordless", "top_word", "dup_trigrams", "ended_lines", "short_words",
)


def features(text: str | None) -> list[float]:
    """Statistics of a whole text, all zero without words."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    data = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    chars = len(text)
    upper, lower = data[65:91].sum(), data[97:123].sum()
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    counts = Counter(words)
    trigrams = max(1, n - 2)
    return [
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        data[list(SYMBOLS)].sum() / chars,
        data[ord("!")] / n,
        upper / max(1, upper + lower),
        data[48:58].sum() / chars,
        data[[ord(c) for c in ".,;:?"]].sum() / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        len(counts) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(n / max(1, len(lines)))),
        sum(v for w, v in counts.items() if w.isascii() and not any(map(str.isalpha, w))) / n,
        max(counts.values()) / n,
        1 - min(1.0, len(set(zip(words, words[1:], words[2:], strict=False))) / trigrams) if n > 2 else 0.0,
        sum(x.rstrip()[-1] in ".!?\"'" for x in lines) / max(1, len(lines)),
        sum(v for w, v in counts.items() if len(w) <= 3) / n,
    ]


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for own, j in zip(self.tables, range(len(b)), strict=True):
            total += own[b[j]]
        for i, j, own in self.pairs:
            total += own[b[i], b[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _split(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram."""
    if len(g) < 2:
        return 0.0, 0
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = a**2 / (b + l2) + (g.sum() - a) ** 2 / (h.sum() - b + l2) - g.sum() ** 2 / (h.sum() + l2)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _shallow(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    """Values of a tree of three leaves at most."""
    _, cut = _split(g, h, l2)
    if not cut:
        return np.full(len(g), g.sum() / (h.sum() + l2))
    (left, a), (right, b) = _split(g[:cut], h[:cut], l2), _split(g[cut:], h[cut:], l2)
    cuts = [0, *sorted({cut, a if left >= right else cut + b} - {0}), len(g)]
    out = np.empty(len(g))
    for i, j in zip(cuts, cuts[1:], strict=False):
        out[i:j] = g[i:j].sum() / (h[i:j].sum() + l2) if j > i else 0
    return out


def _cross(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    """Values of a tree that splits the first axis, then either side along the second."""
    _, cut = _split(g.sum(1), h.sum(1), l2)
    out = np.empty(g.shape)
    for part in (slice(0, cut), slice(cut, None)):
        gs, hs = g[part].sum(0), h[part].sum(0)
        _, at = _split(gs, hs, l2)
        for low in (slice(0, at), slice(at, None)):
            out[part, low] = gs[low].sum() / (hs[low].sum() + l2)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, pair_rounds: int = 60, most_pairs: int = 8, bins: int = 32, rate: float = 0.08, l2: float = 2.0) -> Model:
    """The model from feature rows and 0/1 labels; without rows every score is 0.5."""
    n = len(y)
    prior = (y.sum() + 0.5) / (n + 1)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(x.shape[1])]
    model = Model(float(np.log(prior / (1 - prior))), edges, [np.zeros(len(e) + 1) for e in edges])
    if n == 0 or y.min() == y.max():
        return model
    b = model.bins(x)
    total = np.full(n, model.intercept)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, own in enumerate(model.tables):
            g, h = residual()
            step = rate * _shallow(np.bincount(b[j], g, len(own)), np.bincount(b[j], h, len(own)), l2)
            own += step
            total += step[b[j]]
    g, h = residual()
    ranked = []
    for i, j in combinations(range(len(edges)), 2):
        shape = len(edges[i]) + 1, len(edges[j]) + 1
        cell = b[i] * shape[1] + b[j]
        gs, hs = (np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))
        tree = _cross(gs, hs, l2)
        ranked.append((float((tree * gs - tree**2 * hs / 2).sum()), i, j))
    chosen = [(i, j, np.zeros((len(edges[i]) + 1, len(edges[j]) + 1))) for gain, i, j in sorted(ranked, reverse=True)[:most_pairs] if gain > 0]
    for _ in range(pair_rounds):
        for i, j, own in chosen:
            g, h = residual()
            cell = b[i] * own.shape[1] + b[j]
            step = rate * _cross(*(np.bincount(cell, v, own.size).reshape(own.shape) for v in (g, h)), l2)
            own += step
            total += step[b[i], b[j]]
    model.pairs = chosen
    return model


def _matrix(batch: pa.RecordBatch, text: str) -> np.ndarray:
    return np.array([features(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on ``quality`` of the labelled documents outside the held-out fold.

    Labels with a null id or quality are left out; an id that is labelled several times has
    the mean of its labels and counts once, of rows that repeat an id that with the smallest
    text is taken. At most ``sample`` ids (16 bytes each, so what is broadcast is bounded)
    and as many rows of features reach the driver.
    """
    chosen = labels.filter("quality is not null and doc_id is not null").filter(crc_mod("doc_id", FOLDS) != HELD_OUT)
    chosen = chosen.groupBy(F.col("doc_id").alias("labelled")).agg(F.avg(F.col("quality").cast("int")).alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("labelled"), "labelled").limit(sample)
    chosen = stored(chosen, "labels")  # taken twice
    # one row for each id, so that rows that repeat an id don't pile up
    texts = one_row_per(docs.select("doc_id", "text"), chosen.select(F.col("labelled").alias("picked")), "doc_id", "text")
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select("doc_id", "text", "quality")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            x = _matrix(batch, "text")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    found = sorted(tuple(r) for r in rows.mapInArrow(run, f"doc_id {kind}, quality double, x array<double>").collect())
    x = np.array([r[2] for r in found]).reshape(len(found), len(FEATURES))
    return fit(x, np.array([r[1] for r in found]))


def classify(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with ``score`` (0 to 1, higher: better quality) and ``predicted`` (1 if score >= threshold).

    Empty and null texts are scored as texts without words, texts of any length whole.
    Equal texts have equal scores, repeated rows stay repeated, and a score that ties with
    the threshold counts as reaching it. Columns named score or predicted give way.
    """
    rest = fresh(docs, "score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            score = shared.value.score(_matrix(batch, text))
            yield with_columns(batch, [("score", pa.float64(), pa.array(score)), ("predicted", pa.int32(), pa.array((score >= threshold).astype(np.int32)))])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(run, f"{schema}, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    return classify(docs, model).select("doc_id", held_out, "score", "predicted")


QUERIES = {"op9_quality": query}
