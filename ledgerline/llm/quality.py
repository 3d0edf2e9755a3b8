"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a text is logistic(w0 + sum w_i x_i + pairwise), where the pairwise interactions of all features are summed in
linear time by (sum_f (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2) / 2. Features are the hashed words with their counts over the
root of the number of words, and statistics of the text's structure and length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_batches

BUCKETS = 1 << 14
RANK = 6
# The model is fitted on at most this many labelled rows, the first by a hash of their ids.
SAMPLE = 5000
HELD_OUT = 5
THRESHOLD = 0.3

STATS = (
    "log_chars", "log_words", "log_lines", "word_length", "word_length_spread", "distinct_words", "top_word",
    "repeated_neighbours", "upper", "digits", "white", "symbols", "marked_words", "mean_line", "distinct_lines", "non_ascii",
)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of at most `most` labelled rows that may be learned from, and how many ids bear each label.

    At most half of the rows bear one label. Rows with a null id or label are left out, a label above 0 counts as 1, an id labelled more than
    once counts with its larger label. The rows are the first by a hash of the id, found in the narrow label table before any text is read.
    """
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(label) > 0).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    totals = {row["label"]: row["count"] for row in marked.groupBy("label").count().collect()}  # two rows
    first = [
        marked.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for k in (0, 1)
    ]
    picked = F.broadcast(first[0].union(first[1]))  # `most` rows bound its size
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.join(picked, "doc_id"), totals


class Featurizer:
    """Hashed words (with counts) and statistics of texts; a worker remembers the bucket and marks of frequent words."""

    def __init__(self, most: int = 250_000) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def bucket(self, word: str) -> int:
        return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % BUCKETS

    def words(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words, the distinct buckets and their counts."""
        words = text.split()
        counts = Counter(words)
        known = self.known
        buckets = np.empty(len(counts), dtype=np.int64)
        for place, word in enumerate(counts):
            found = known.get(word)
            if found is None:
                found = self.bucket(word)
                if len(known) < self.most:
                    known[word] = found
            buckets[place] = found
        times = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
        if not len(buckets):
            return words, buckets, times
        sums = np.bincount(buckets, weights=times)
        ids = np.flatnonzero(sums)
        return words, ids, sums[ids]

    def stats(self, text: str, words: list[str]) -> list[float]:
        n, chars = max(1, len(words)), max(1, len(text))
        lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
        counts = Counter(words)
        lines = text.split("\n")
        # ASCII classes are counted on the bytes; other letters count under non_ascii
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        kinds = np.bincount(CLASS[data], minlength=6) / chars
        same = sum(map(str.__eq__, words, words[1:]))
        marked = len(MARKED.findall(text))
        return [
            np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), lengths.mean() / 10, lengths.std() / 10,
            len(counts) / n, (max(counts.values()) if counts else 0) / n, same / n, kinds[1], kinds[2], kinds[3], kinds[4],
            marked / n, np.log1p(len(text) / len(lines)), len(set(lines)) / len(lines), kinds[5],
        ]


MARKED = re.compile(r"[^\w\s]{2,}|\s[^\w\s]\s")
# 0 lower-case letters, 1 upper case, 2 digits, 3 white space, 4 symbols, 5 bytes of other characters
CLASS = np.array(
    [5 if b > 127 else 3 if chr(b).isspace() else 2 if chr(b).isdigit() else 1 if chr(b).isupper() else 0 if chr(b).isalpha() else 4
     for b in range(256)]
)


class Machine:
    """A factorisation machine; `values` are the parameters as plain arrays, so that a task gets them with its function."""

    def __init__(self, bias: float, linear: np.ndarray, factors: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> None:
        self.bias, self.linear, self.factors, self.mean, self.scale = bias, linear, factors, mean, scale

    def margin(self, ids: np.ndarray, x: np.ndarray) -> float:
        """Linear part plus all pairwise interactions, in time linear in the number of features."""
        weighted = self.factors[ids] * x[:, None]
        total = weighted.sum(axis=0)
        return float(self.bias + self.linear[ids] @ x + 0.5 * (total @ total - (weighted * weighted).sum()))

    def row(self, ids: np.ndarray, counts: np.ndarray, stats: list[float]) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((np.array(stats) - self.mean) / self.scale, -4, 4)
        x = counts / np.sqrt(max(1.0, counts.sum()))
        return np.concatenate([ids, np.arange(BUCKETS, BUCKETS + len(z))]), np.concatenate([x / max(1.0, np.linalg.norm(x)), z / 2])


def fit(rows: pd.DataFrame, epochs: int = 12, rate: float = 0.05, seed: int = 5) -> Machine:
    """Logistic loss and AdaGrad over the sampled rows; classes weigh the same. Rows: ids, counts, stats, label."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + len(STATS)
    machine = Machine(
        0.0, np.zeros(size), rng.normal(0, 0.02, (size, RANK)), np.zeros(len(STATS)), np.ones(len(STATS))
    )
    if not len(rows):
        return machine
    stats = np.array(rows["stats"].tolist())
    machine.mean, machine.scale = stats.mean(axis=0), stats.std(axis=0) + 1e-3
    data = [
        machine.row(np.asarray(i, dtype=np.int64), np.asarray(c), s) for i, c, s in zip(rows["ids"], rows["counts"], stats, strict=True)
    ]
    y = rows["label"].to_numpy()
    ones = int((y > 0).sum())
    share = {1: 0.5 / max(1, ones), 0: 0.5 / max(1, len(y) - ones)}
    weight = np.array([share[int(v > 0)] for v in y]) * len(y)
    past_linear, past_factors, past_bias = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            ids, x = data[k]
            v = machine.factors[ids]
            total = (v * x[:, None]).sum(axis=0)
            margin = machine.bias + machine.linear[ids] @ x + 0.5 * (total @ total - ((v * x[:, None]) ** 2).sum())
            slope = weight[k] * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - (y[k] > 0))
            step = slope * x + 1e-4 * machine.linear[ids]
            past_linear[ids] += step**2
            machine.linear[ids] -= rate * step / np.sqrt(past_linear[ids])
            steps = slope * (x[:, None] * total - v * (x**2)[:, None]) + 1e-4 * v
            past_factors[ids] += steps**2
            machine.factors[ids] = v - rate * steps / np.sqrt(past_factors[ids])
            past_bias += slope**2
            machine.bias -= rate * slope / np.sqrt(past_bias)
    return machine


FEATURES = "label int, ids array<int>, counts array<double>, stats array<double>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    maker = Featurizer()
    for batch in batches:
        out: list[list] = [[], [], []]
        for text in batch.column(1).to_pylist():
            words, ids, counts = maker.words(text)
            out[0].append(ids.tolist())
            out[1].append(counts.tolist())
            out[2].append(maker.stats(text, words))
        kinds = [pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(values, kind) for values, kind in zip(out, kinds, strict=True)]],
            ["label", "ids", "counts", "stats"],
        )


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Machine:
    """Features are made by the executors; the driver gets those of at most `most` rows and fits the model."""
    rows, _ = labelled_sample(docs, labels, label, most)
    return fit(arrow_batches(rows.select("label", "text"), _features, FEATURES).toPandas())


def scores(docs: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row, between 0 and 1.

    A null text counts as empty, and an empty text has the score of its structure statistics. Repeated rows repeat, null ids
    stay null, other columns are not read; an empty table gives no rows. Texts of any length are scored whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Featurizer()
        for batch in batches:
            out = []
            for value in batch.column(1).to_pylist():
                value = value or ""
                words, ids, counts = maker.words(value)
                out.append(machine.margin(*machine.row(ids, counts, maker.stats(value, words))))
            score = 1 / (1 + np.exp(-np.clip(np.array(out, dtype=float), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return arrow_batches(rows, run, "doc_id long, score double")


def keep_good(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` with a score of at least `threshold`; all columns stay. The text is scored where it lies."""
    from ledgerline.session import ship_package

    ship_package(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        maker = Featurizer()
        out = []
        for value in texts:
            words, ids, counts = maker.words(value)
            out.append(1 / (1 + np.exp(-np.clip(machine.margin(*machine.row(ids, counts, maker.stats(value, words))), -30, 30))))
        return pd.Series(out, dtype=float)

    return docs.where(score(F.coalesce(F.col("text").cast("string"), F.lit(""))) >= threshold)
