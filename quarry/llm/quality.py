"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in Arrow batches.  The trees are grown on the driver from a bounded sample
of labelled rows (``MAX_TRAIN``, the rows with the smallest hash of doc_id) and flattened into arrays, which
travel to the executors (their size depends on trees and depth only) and are walked level by level in numpy for a
whole batch of documents at once.

Defined results: a null text counts as empty and is scored like any text; rows without a usable label (null
doc_id or quality) do not train; of repeated labels the highest counts, of rows that repeat a doc_id the text with
the smallest digest; a null doc_id is not held out; with no usable label, or one class only,
every score is that class (1 without labels); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.words import SPACE, texts_in, words

MAX_TRAIN = 20_000
THRESHOLD = 0.7
FEATURES = (
    "log_bytes", "letters", "upper", "digits", "spaces", "high", "newlines", "sentence_marks", "commas", "pipes", "hashes", "stars", "percent", "dollar", "ampersand", "exclaim", "brackets", "slashes", "other_marks",
    "byte_entropy", "log_words", "word_length", "word_length_sd", "long_words", "short_words", "distinct_words", "top_word", "repeated_pairs", "repeated_triples", "marked_words", "upper_ends", "upper_starts", "digit_starts",
    "log_lines", "line_length", "repeated_lines", "repeated_line_bytes", "unmarked_lines",
)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_UPPER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_PLAIN = _MARK.copy()
_MARK[[ord(c) for c in ".,;:?"]] = False


def _repeated(codes: np.ndarray) -> float:
    if not len(codes):
        return 0.0
    codes = np.sort(codes)
    return float((codes[1:] == codes[:-1]).sum()) / len(codes)


def statistics(source: bytes) -> list[float]:
    """The FEATURES of one whole text, given as UTF-8."""
    raw, text = np.frombuffer(source, np.uint8), source.decode("utf-8", "replace")
    count = np.bincount(raw, minlength=256)
    n = max(1, len(raw))
    share = lambda s: sum(int(count[ord(c)]) for c in s) / n
    letters, upper, digits, high = int(count[65:91].sum() + count[97:123].sum()), int(count[65:91].sum()), int(count[48:58].sum()), int(count[128:].sum())
    spaces = int(count[32] + count[9:14].sum())
    p = count[count > 0] / n

    first, end, ids = words(raw, ~SPACE)
    last, m = end - 1, len(first)
    w, lengths = max(1, m), (end - first) if m else np.zeros(1, np.int64)
    pairs = ids[:-1] * _ODD + ids[1:]
    triples = pairs[:-1] * _ODD + ids[2:]
    ordered = np.sort(ids)
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if m else np.zeros(1, np.int64)
    v, top = len(starts), np.diff(starts, append=m).max()

    lines = [x for x in (y.strip() for y in text.split("\n")) if x]
    k = max(1, len(lines))
    known = set(lines)
    twice = len(text) and (sum(map(len, lines)) - sum(map(len, known))) / len(text)
    marks = share(".!?"), share(",;:"), share("|"), share("#"), share("*"), share("%"), share("$"), share("&"), share("!"), share("()[]{}<>"), share("/\\")
    return [
        np.log1p(len(raw)), letters / n, upper / max(1, letters), digits / n, spaces / n, high / n, int(count[10]) / n, *marks, int(count[_PLAIN].sum()) / n - sum(marks) + marks[8],
        float(-(p * np.log2(p)).sum()), np.log1p(m), float(lengths.mean()), float(lengths.std()), float((lengths > 12).sum()) / w, float((lengths < 3).sum()) / w, v / w, float(top) / w, _repeated(pairs), _repeated(triples),
        float(_MARK[raw[last]].sum()) / w, float(_UPPER[raw[last]].sum()) / w, float(_UPPER[raw[first]].sum()) / w, float(_DIGIT[raw[first]].sum()) / w,
        np.log1p(len(lines)), np.log1p(len(text) / k), 1 - len(known) / k if lines else 0.0, twice, sum(1 for x in lines if x[-1] not in ".!?:\"'") / k,
    ]


def matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([statistics(x) for x in texts], np.float64).reshape(len(texts), len(FEATURES))


def column_matrix(column: pa.Array) -> np.ndarray:
    """The features of a text column; a null is empty."""
    return np.concatenate([np.zeros((0, len(FEATURES))), *(matrix(raws) for _, _, raws in texts_in(column))])


class Trees:
    """Boosted trees of equal depth in flat arrays: node i of a tree has children 2i+1 and 2i+2."""

    def __init__(self, base: float, depth: int, feature: np.ndarray, split: np.ndarray, leaf: np.ndarray) -> None:
        self.base, self.depth, self.feature, self.split, self.leaf = base, depth, feature, split, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, split, leaf in zip(self.feature, self.split, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > split[node])
            out += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 150, depth: int = 4, rate: float = 0.1, bins: int = 64, least: float = 2.0, ridge: float = 1.0) -> Trees:
    """Boost logistic loss; splits are searched in histograms of at most ``bins`` quantile bins."""
    none = np.zeros((0, 2**depth - 1))
    if not len(y) or y.min() == y.max():
        return Trees(30.0 if not len(y) or y[0] else -30.0, depth, none.astype(int), none, np.zeros((0, 2**depth)))
    n, f = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(f)]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    flat = code + np.arange(f) * bins
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin, out = np.full(n, base), ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        feature, split = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            k, first = 2**level, 2**level - 1
            where = ((node - first)[:, None] * (f * bins) + flat).ravel()
            gs = np.bincount(where, np.repeat(g, f), k * f * bins).reshape(k, f, bins).cumsum(2)
            hs = np.bincount(where, np.repeat(h, f), k * f * bins).reshape(k, f, bins).cumsum(2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain = np.where((hs >= least) & (ht - hs >= least), gain, 0).reshape(k, -1)
            best = gain.argmax(1)
            for i in np.flatnonzero(gain.max(1) > 1e-9):
                j, b = divmod(int(best[i]), bins)
                if b < len(cuts[j]):
                    feature[first + i], split[first + i] = j, cuts[j][b]
            at = node
            node = 2 * node + 1 + (x[np.arange(n), feature[at]] > split[at])
        end = node - (2**depth - 1)
        leaf = -rate * np.bincount(end, g, 2**depth) / (np.bincount(end, h, 2**depth) + ridge)
        margin = margin + leaf[end]
        for to, part in zip(out, (feature, split, leaf)):
            to.append(part)
    return Trees(base, depth, *(np.array(part) for part in out))


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = pa.array(list(column_matrix(batch.column("text"))), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), batch.column("digest"), x], names=["doc_id", "y", "digest", "x"])


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Trees:
    """Train on labelled rows whose crc32(doc_id) mod 4 is not 2; at most ``max_train`` of them, by hash."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    usable = usable.where(remainder(F.col("doc_id")) != 2).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # max_train rows
    rows = rows.select("doc_id", "y", "text", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))
    each = rows.mapInArrow(_features, "doc_id long, y int, digest string, x array<double>")
    got = each.groupBy("doc_id", "y").agg(F.min_by("x", "digest").alias("x")).toPandas()  # max_train rows at most
    got = got.sort_values("doc_id", kind="stable")
    x = np.array(list(got["x"]), np.float64).reshape(len(got), len(FEATURES))
    return grow(x, got["y"].to_numpy(np.float64))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.7) of every row."""
    trees = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = rows.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sent.value.score(column_matrix(batch.column("text"))))], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the classifier accepts, with their columns."""
    trees = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.score(column_matrix(batch.column("text"))) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
