"""Quality classifier: histogram gradient-boosted trees over statistics of a text.

Statistics are counted over whole texts in Arrow batches. Trees are fitted in
numpy on a bounded sample of labelled rows (``SAMPLE_ROWS``, those with the
smallest hashes of their id): every feature is cut into bins once, each node sums
gradients and hessians per bin, and the best cut of those sums splits it. The
fitted trees are complete binary trees flattened into three arrays (feature,
threshold, leaf value); a batch of documents walks all trees level by level with
array indexing, so scoring has no loop over rows. Only the arrays travel to the
tasks (some 30 KB); no score depends on other rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwave.llm.common import map_arrow

# Bound of the labelled rows a model is fitted on.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2, MIN_ROWS = 60, 4, 64, 0.15, 1.0, 5

FEATURES = (
    "log_chars", "log_words", "word_len", "lines_per_word", "line_chars", "upper", "digit", "space", "ascii_symbol",
    "pipe", "bang", "star_hash", "percent_amp", "dollar", "period", "comma", "colon_slash", "distinct_words",
    "top_word", "repeated_next", "longest_word", "distinct_lines", "symbol_words", "upper_words", "letters",
)
_SYMBOL_WORD = re.compile(r"\S*[^\w\s.,;:'\"?()-]\S*")


def statistics(text: str | None) -> list[float]:
    """The FEATURES of one text; null counts as empty, where every ratio is 0."""
    text = text or ""
    n = len(text)
    words = text.split()
    k = len(words)
    if not n or not k:
        return [float(np.log1p(n))] + [0.0] * (len(FEATURES) - 1)
    lines = [x for x in text.split("\n") if x.strip()]
    count = text.count
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    upper = sum(map(str.isupper, words))
    symbols = len(_SYMBOL_WORD.findall(text))
    packed = text.translate(_CLASSES)
    digit, cased, space = packed.count("0"), packed.count("A"), packed.count(" ")
    symbol = packed.count("!")
    repeated = sum(map(str.__eq__, words, words[1:]))
    return [
        float(np.log1p(n)), float(np.log1p(k)), sum(map(len, words)) / k, len(lines) / k, n / max(1, len(lines)) / 1000,
        cased / n, digit / n, space / n, symbol / n, count("|") / k, count("!") / k, (count("*") + count("#")) / k,
        (count("%") + count("&")) / k, count("$") / k, count(".") / k, count(",") / k, (count(":") + count("/")) / k,
        len(counts) / k, max(counts.values()) / k, repeated / k, min(max(map(len, words)), 1000) / 100,
        len(set(lines)) / max(1, len(lines)), symbols / k, upper / k, (n - digit - space - symbol) / n,
    ]


# Digits to 0, A-Z to A, white space to a space, other ASCII signs to !; all else stays a letter.
_CLASSES = {
    i: "0" if chr(i).isdigit() else "A" if chr(i).isupper() else " " if chr(i).isspace() else "!"
    for i in range(128)
    if not chr(i).islower()
}


@dataclass(frozen=True)
class Model:
    """``trees`` complete trees of ``depth`` levels: inner nodes by level, then leaves."""

    feature: np.ndarray  # trees x (2**depth - 1)
    threshold: np.ndarray  # the same; a value above it goes right
    leaf: np.ndarray  # trees x 2**depth
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        rows, trees = len(x), len(self.feature)
        at = np.zeros((rows, trees), np.int64)
        tree = np.arange(trees)
        row = np.arange(rows)[:, None]
        for _ in range(self.depth):
            right = x[row, self.feature[tree, at]] > self.threshold[tree, at]
            at = 2 * at + 1 + right
        total = self.base + self.leaf[tree, at - (2**self.depth - 1)].sum(axis=1) if trees else np.full(rows, self.base)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Model:
    """Boosted trees for 0/1 labels; without rows, or with one class, a constant score."""
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or len(np.unique(y)) < 2:
        empty = np.zeros((0, 2**depth - 1))
        return Model(empty.astype(np.int64), empty, np.zeros((0, 2**depth)), base, depth)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    width, n_features = bins, x.shape[1]
    flat = binned + np.arange(n_features) * width
    inner, leaves = 2**depth - 1, 2**depth
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    raw = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first = 2**level - 1
            for k in range(2**level):
                rows = np.flatnonzero(node == first + k)
                if len(rows) < 2 * MIN_ROWS:
                    continue
                cells, shape = flat[rows].ravel(), (n_features, width)
                size = n_features * width
                gs = np.bincount(cells, np.repeat(g[rows], n_features), size).reshape(shape).cumsum(axis=1)
                hs = np.bincount(cells, np.repeat(h[rows], n_features), size).reshape(shape).cumsum(axis=1)
                ns = np.bincount(cells, minlength=size).reshape(shape).cumsum(axis=1)
                gt, ht, nt = gs[:, -1:], hs[:, -1:], len(rows)
                gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
                gain[(ns < MIN_ROWS) | (nt - ns < MIN_ROWS)] = 0
                f, b = divmod(int(gain.argmax()), width)
                if gain[f, b] > 1e-9 and b < len(cuts[f]):
                    feature[t, first + k], threshold[t, first + k] = f, cuts[f][b]
            right = x[np.arange(len(y)), feature[t, node]] > threshold[t, node]
            node = 2 * node + 1 + right
        place = node - inner
        leaf[t] = -RATE * np.bincount(place, g, leaves) / (np.bincount(place, h, leaves) + L2)
        raw += leaf[t, place]
    return Model(feature, threshold, leaf, base, depth)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the column ``_statistics`` (array of double)."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [statistics(t) for t in batch.column(text).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(rows, pa.list_(pa.float64()))], [*batch.schema.names, "_statistics"]
        )

    return map_arrow(docs, text, f"{kinds}, _statistics array<double>", count)


def held_out(key: str) -> Column:
    """True for rows whose label must not be learned: crc32 of the id's text is 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of ``labels.quality`` from at most ``sample_rows`` labelled rows.

    Learns only from rows that are not held out. Labels other than 0 and 1 and null ids
    are passed over; several rows for an id count as one, with the larger
    label and the smallest text.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    # At most sample_rows rows of two numbers: the limit bounds the broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "_y").agg(F.min("text").alias("text"))
    got = sorted((r["doc_id"], r["_y"], r["_statistics"]) for r in with_statistics(rows).drop("text").collect())
    x = np.array([r[2] for r in got], float).reshape(len(got), len(FEATURES))
    return fit(x, np.array([r[1] for r in got], float))


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with score (double) and predicted (int, 1 from 0.5); columns of these names are replaced.

    A null or empty text gets the score of empty statistics. One pass, no shuffle;
    without ``keep_text`` the texts are not sent back from Python.
    """
    docs = docs.drop("score", "predicted")
    fields = [f for f in docs.schema.fields if keep_text or f.name != text]
    names = [f.name for f in fields]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([statistics(t) for t in batch.column(text).to_pylist()], float)
        p = model.score(x)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
            [*names, "score", "predicted"],
        )

    return map_arrow(docs, text, f"{kinds}, score double, predicted int", judge)
