"""Toxicity: a string-kernel support vector machine over words, with Nystroem landmarks.

The kernel counts common subsequences of `ORDER` characters that span at most `SPAN`, each weighed by DECAY to the power of the
characters it spans; word starts and ends are characters of their own. Inserted characters and gaps cost weight but do not
break a match. A text is a bag of words (runs of single characters are joined to one word first), and it is as toxic as its
worst word: a multiple-instance machine chooses the word of each toxic training text that counts, against the worst words of
the others. Words are seen through their kernels with the landmarks (Nystroem features).

A kernel with fixed landmarks is linear in the subsequences, so for scoring the landmarks are folded into one weight per
subsequence. That is the same number as the sum over landmarks.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_batches
from ledgerline.llm.quality import labelled_sample

ORDER = 5
SPAN = 6
DECAY = 0.6
# Places of the other characters after the first.
OFFSETS = list(combinations(range(1, SPAN), ORDER - 1))
CODES = 128
# Subsequences are told apart by a hash of this many values.
HASHED = 1 << 21
START, STOP = 1, 2
LONGEST = 40
# The model is fitted on at most this many labelled rows, the first by a hash of their ids.
SAMPLE = 4000
LANDMARKS = 96
ROUNDS = 6

NOT_WORD = re.compile(r"[^\w]+|_")
# Separators and letters share no character and nothing is given back, so that a scan takes time in proportion to the text.
SPACED = re.compile(r"(?<!\S)[^\W_](?:[\s.*_-]++[^\W_](?![^\W_])){2,}+")


def units(text: str) -> set[str]:
    """Distinct words as written, and what runs of at least three single characters spell; a run ends before white space or with the text."""
    words = set(text.split())
    for found in SPACED.finditer(text):
        run = found.group()
        if not text[found.end() : found.end() + 1].strip():
            words.add("".join(run.split()))
        else:  # the run goes on with something else: up to its last letter before white space
            whole = run[: max((i for i in range(1, len(run)) if run[i].isspace() and run[i - 1].isalnum()), default=0)]
            if sum(c.isalnum() for c in whole) >= 3:
                words.add("".join(whole.split()))
    return words


def plain(word: str) -> str:
    return NOT_WORD.sub("", word.lower())


def cut(word: str) -> list[str]:
    """Pieces of a plain word of at most LONGEST characters; a piece shares SPAN characters with the next, so that no subsequence is lost."""
    return [word[start : start + LONGEST] for start in range(0, max(1, len(word) - SPAN), LONGEST - SPAN)] if word else []


def coded(words: list[str]) -> np.ndarray:
    """One row of character codes per word, start and end included, zero after the end; long words are cut into LONGEST-character pieces by the caller."""
    width = max((len(word) for word in words), default=0) + 2
    out = np.zeros((len(words), width + SPAN), dtype=np.int64)
    for row, word in enumerate(words):
        points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        out[row, 0] = START
        out[row, 1 : len(word) + 1] = 3 + (points ^ (points >> 7) * 37) % (CODES - 3)
        out[row, len(word) + 1] = STOP
    return out


def subsequences(words: list[str]) -> Iterator[tuple[float, np.ndarray]]:
    """For each pattern of gaps: its weight, and the code of the subsequence at every place of every word (-1 where it ends outside)."""
    codes = coded(words)
    width = codes.shape[1] - SPAN
    first = codes[:, :width]
    for offsets in OFFSETS:
        code = first
        for k in offsets:
            code = code * CODES + codes[:, k : width + k]
        code = (code ^ (code >> 17)) * 0x2545F491 >> 7 & (HASHED - 1)
        yield DECAY ** (offsets[-1] + 1), np.where(codes[:, offsets[-1] : width + offsets[-1]] > 0, code, -1)


def lengths(words: list[str]) -> np.ndarray:
    """Root of the summed squared weights: the norm that words are scaled by."""
    total = np.zeros(len(words))
    for weight, found in subsequences(words):
        total += weight**2 * (found >= 0).sum(axis=1)
    return np.sqrt(np.maximum(total, 1e-12))


def kernels(words: list[str], marks: list[str]) -> np.ndarray:
    """Kernel of every word with every landmark."""
    places: dict[int, int] = {}
    entries: list[tuple[int, int, float]] = []
    for weight, found in subsequences(marks):
        for mark, row in enumerate(found):
            for code in row[row >= 0].tolist():
                entries.append((places.setdefault(code, len(places)), mark, weight))
    table = np.zeros((len(places) + 1, len(marks)))
    for place, mark, weight in entries:
        table[place, mark] += weight
    table /= lengths(marks)[None, :]
    index = np.full(HASHED, len(places), dtype=np.int32)
    index[np.fromiter(places, dtype=np.int64, count=len(places))] = np.arange(len(places))
    out = np.zeros((len(words), len(marks)))
    for start in range(0, len(words), 2000):
        part = words[start : start + 2000]
        for weight, found in subsequences(part):
            at = np.where(found >= 0, index[np.maximum(found, 0)], len(places))
            rows, columns = np.nonzero(at < len(places))
            if len(rows):
                begins = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                out[rows[begins] + start] += weight * np.add.reduceat(table[at[rows, columns]], begins, axis=0)
        out[start : start + 2000] /= lengths(part)[:, None]
    return out


class Judge:
    """Weights of subsequences, a bias and a calibration; scores words, and texts by their WORST worst words."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, bias: float, curve: np.ndarray, default: float) -> None:
        self.codes, self.weights, self.bias, self.curve, self.default = codes, weights, bias, curve, default
        self.table: np.ndarray | None = None
        self.known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None, "known": {}}

    def words(self, words: list[str]) -> np.ndarray:
        """Decision value of each word; an empty word is never toxic."""
        if self.table is None:
            self.table = np.zeros(HASHED, dtype=np.float32)
            self.table[self.codes] = self.weights
        out = np.full(len(words), -np.inf)
        plains = [plain(word) for word in words]
        owners, pieces = [], []
        for row, word in enumerate(plains):
            for piece in cut(word):
                owners.append(row)
                pieces.append(piece)
        order = sorted(range(len(pieces)), key=lambda k: len(pieces[k]))
        for start in range(0, len(order), 4000):
            some = order[start : start + 4000]
            part = [pieces[k] for k in some]
            total = np.zeros(len(part))
            for weight, found in subsequences(part):
                total += weight * np.where(found >= 0, self.table[np.maximum(found, 0)], 0).sum(axis=1)
            np.maximum.at(out, [owners[k] for k in some], total / lengths(part) + self.bias)
        return out

    def texts(self, texts: list[str], most: int = 300_000) -> np.ndarray:
        """Probability of each text; texts without a word get the share of toxic texts among those without one, near zero."""
        bags = [units(text) for text in texts]
        new = list(set().union(*bags).difference(self.known))
        found = dict(zip(new, self.words(new).tolist(), strict=True))
        if len(self.known) + len(found) <= most:
            self.known.update(found)
            lookup = self.known.__getitem__
        else:
            known = self.known
            lookup = lambda word: known[word] if word in known else found[word]
        shapes = [shape(list(map(lookup, bag))) for bag in bags]
        return np.array([self.default if x is None else chance(x @ self.curve) for x in shapes])


WORST = 4


def shape(decisions: list[float]) -> np.ndarray | None:
    """What the calibration sees of a text: its worst words, how many there are, and one; None without words."""
    worst = [d for d in heapq.nlargest(WORST, decisions) if d > -math.inf]
    if not worst:
        return None
    # a missing word counts as one as harmless as can be
    return np.array([max(-2.0, d) for d in worst] + [-2.0] * (WORST - len(worst)) + [math.log1p(len(decisions)) / 4, 1.0])


def chance(margin: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))


def separate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by Newton steps. y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        gap = 1 - y * (x @ w)
        on = gap > 0
        xs, ws = x[on], weight[on]
        slope = penalty * w - xs.T @ (ws * y[on] * gap[on])
        step = np.linalg.solve(np.diag(penalty) + (xs * ws[:, None]).T @ xs, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(vocabulary: list[str], rows: list[np.ndarray], labels: np.ndarray, totals: dict[int, int] | None = None, seed: int = 3) -> Judge:
    """The machine from bags of words, as places in a sorted vocabulary, with labels 0 and 1. Without both labels every text gets the share of ones."""
    n_toxic = int((labels > 0).sum())
    if not 0 < n_toxic < len(labels):
        share = float(n_toxic > 0) if len(labels) else 0.0
        curve = np.zeros(WORST + 2)
        curve[-1] = 30.0 * (2 * share - 1)
        return Judge(np.zeros(0, dtype=np.int64), np.zeros(0), 0.0, curve, share)
    rng = np.random.default_rng(seed)
    toxic, clean = counts(rows, labels > 0, len(vocabulary)), counts(rows, labels <= 0, len(vocabulary))
    n_clean = len(labels) - n_toxic

    def told(in_toxic: np.ndarray, in_clean: np.ndarray) -> np.ndarray:
        """How much likelier a toxic text is to hold each word, for words that recur."""
        return np.log((in_toxic + 0.1) / (n_toxic + 1)) - np.log((in_clean + 0.5) / (n_clean + 1))

    # subsequences of word starts tell families of words before any word recurs
    likely = told(toxic, clean)
    for k in (4, 5):
        starts: dict[str, int] = {}
        of = np.array([starts.setdefault(w[:k], len(starts)) if len(w) >= k else -1 for w in vocabulary], dtype=np.int64)
        if starts:
            found = [np.unique(of[row]) for row in rows]
            found = [row[1:] if len(row) and row[0] < 0 else row for row in found]
            stem = told(counts(found, labels > 0, len(starts)), counts(found, labels <= 0, len(starts)))
            likely = np.maximum(likely, np.where(of >= 0, stem[of], -9.0))
    # of equally likely words the more frequent one, then the last
    chosen = {n: int(row[np.lexsort((row, toxic[row], likely[row]))[-1]]) for n, row in enumerate(rows) if labels[n] > 0 and len(row)}
    families = Counter(vocabulary[place] for place in chosen.values())
    marks: list[str] = []
    stems: Counter = Counter()
    for word, _ in sorted(families.items(), key=lambda kv: (-kv[1], kv[0])):
        if stems[word[:4]] < 4:  # landmarks from every family of words
            stems[word[:4]] += 1
            marks.append(word)
        if len(marks) >= LANDMARKS * 3 // 4:
            break
    common = [vocabulary[k] for k in np.argsort(-clean, kind="stable")[:2000].tolist() if clean[k] and len(vocabulary[k]) > 2]
    marks += [str(w) for w in rng.permutation(common)[: LANDMARKS - len(marks)]] if common else []
    marks = list(dict.fromkeys(marks))
    values, vectors = np.linalg.eigh(kernels(marks, marks))
    use = values > 1e-3 * values.max()
    whiten = vectors[:, use] / np.sqrt(values[use])
    features = np.empty((len(vocabulary), whiten.shape[1]), dtype=np.float32)
    for start in range(0, len(vocabulary), 10_000):
        features[start : start + 10_000] = kernels(vocabulary[start : start + 10_000], marks) @ whiten
    hard: set[int] = {int(k) for k in rng.permutation(len(vocabulary))[:3000] if not toxic[k]}
    solution = np.zeros(features.shape[1] + 1)
    for turn in range(ROUNDS):
        ones = np.fromiter(chosen.values(), dtype=np.int64)
        zeros = np.fromiter(sorted(hard), dtype=np.int64, count=len(hard))
        x = np.vstack([features[ones], features[zeros]]).astype(np.float64)
        y = np.concatenate([np.ones(len(ones)), -np.ones(len(zeros))])
        weight = np.concatenate([np.full(len(ones), 1.0 / max(1, len(ones))), np.full(len(zeros), 1.0 / max(1, len(zeros)))]) * 1000
        solution = separate(x, y, weight, ridge=1.0)
        decision = (features @ solution[:-1].astype(np.float32)).astype(np.float64) + solution[-1]
        for k, row in enumerate(rows):
            if not len(row):
                continue
            worst = int(row[np.argmax(decision[row])])
            if labels[k] > 0:
                chosen[k] = worst
            else:
                hard.add(worst)
    shapes = [shape(decision[row].tolist()) for row in rows]
    seen = np.array([x is not None for x in shapes])
    share = {k: (totals or {}).get(k, 0) / max(1, int(((labels > 0) == k).sum())) or 1.0 for k in (0, 1)}
    curve = calibrate(np.array([x for x in shapes if x is not None]), labels[seen] > 0, share)
    empty = labels[~seen]
    default = min(0.49, float((empty > 0).mean())) if len(empty) >= 20 else 0.0
    alpha = whiten @ solution[:-1]
    weights: Counter = Counter()
    scale = lengths(marks)
    for gap, found in subsequences(marks):
        for mark, row in enumerate(found):
            for code in row[row >= 0].tolist():
                weights[code] += alpha[mark] * gap / scale[mark]
    codes = np.fromiter(weights, dtype=np.int64, count=len(weights))
    return Judge(codes, np.fromiter(weights.values(), dtype=np.float64, count=len(weights)), float(solution[-1]), curve, default)


def counts(rows: list[np.ndarray], of: np.ndarray, size: int) -> np.ndarray:
    """In how many of some bags each place occurs."""
    some = [row for row, counted in zip(rows, of, strict=True) if counted]
    return np.bincount(np.concatenate([np.zeros(0, dtype=np.int64), *some]), minlength=size)


def calibrate(x: np.ndarray, y: np.ndarray, share: dict[int, float]) -> np.ndarray:
    """Coefficients of a logistic curve, by damped Newton steps with a little shrinkage; rows weigh what their label stands for."""
    w = np.zeros(x.shape[1])
    weight = np.where(y, share[1], share[0])
    weight = weight / weight.mean()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 1e-1 * w
        v = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * v[:, None]).T @ x + 1e-1 * np.eye(len(w)), grad)
        w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return w


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        told = ({piece for word in units(text) for piece in cut(plain(word))} for text in batch.column(1).to_pylist())
        bags = pa.array([sorted(bag) for bag in told], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(0), bags], ["label", "words"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> Judge:
    """Bags of words are made by the executors; the driver gets those of at most `most` rows and fits the machine."""
    rows, totals = labelled_sample(docs, labels, label, most)
    sample = arrow_batches(rows.select("label", "text"), _bags, "label int, words array<string>").toArrow()
    return fit(*bagged(sample.column("words")), sample.column("label").to_numpy(), totals)


def bagged(words: pa.ChunkedArray) -> tuple[list[str], list[np.ndarray]]:
    """The sorted vocabulary of lists of words, and each list as sorted places in it; a distinct word becomes one Python string."""
    lists = pa.concat_arrays(words.chunks) if words.num_chunks else pa.array([], words.type)
    coded = lists.flatten().dictionary_encode()
    found = coded.dictionary.to_pylist()
    order = sorted(range(len(found)), key=found.__getitem__)
    place = np.empty(len(found), dtype=np.int64)
    place[order] = np.arange(len(found))
    places = place[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    return [found[k] for k in order], [np.sort(row) for row in np.split(places, ends[:-1])] if len(lists) else []


def scores(docs: DataFrame, judge: Judge, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row, between 0 and 1.

    A null text counts as empty; texts without any word get the share of toxic ones among such training texts, below one half. Repeated rows
    repeat, null ids stay null, other columns are not read; an empty table gives no rows. Every word of a text of any length is judged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [value or "" for value in batch.column(1).to_pylist()]
            out = np.concatenate([judge.texts(texts[k : k + 64]) for k in range(0, len(texts), 64)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return arrow_batches(rows, run, "doc_id long, score double")
