"""SentencePiece encoding and decoding by vectorised merge rounds.

A text becomes words (a run of spaces and what follows it), and each task encodes the words that it has not met lately all at once: their characters
are one flat array, cut where no piece of the vocabulary holds the two characters side by side. In a round every segment finds its best pair
by a segmented minimum of pair ranks and merges all its occurrences from the left; segments without a pair leave the array. The
rounds end when none is left. The library is asked for its vocabulary only.

Merging one occurrence can create a pair that ranks before the remaining occurrences (or ties with them further left). A segment's merges of a
round end with the first such occurrence, so that the order is the library's: best score first, leftmost among equals.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import Recent, arrow_batches

SPACE = "▁"
WORD = re.compile(f"{SPACE}+[^{SPACE}]*")
NEVER = np.int32(2**31 - 1)
# A segment of more symbols goes through a queue of pairs instead, since one merge a round would cost the square of its length.
LONG = 2048
# Texts that are encoded at a time, and characters of new words that share the rounds.
TEXTS = 128
CHARACTERS = 1 << 20
CACHE_BYTES = 48 << 20

codecs.register_error("one_mark_a_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Vocabulary:
    """Tables of one BPE model with byte fallback; user-defined pieces are not supported."""

    shared: dict[str, Vocabulary] = {}

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        byte = [i for i in range(size) if model.is_byte(i)]
        silent = [i for i in range(size) if model.is_control(i)]
        special = {*byte, *silent, *(i for i in range(size) if model.is_unknown(i))}
        names = [model.id_to_piece(i) for i in range(size)]
        ids = {names[i]: i for i in range(size) if i not in special}
        scores = {name: model.get_score(i) for name, i in ids.items()}
        self.size = size
        self.byte_ids = np.zeros(256, dtype=np.int32)
        for i in byte:
            self.byte_ids[int(names[i][1:-1], 16)] = i
        # characters that only longer pieces hold are symbols, too, though no piece
        symbols = dict(ids)
        for name in ids:
            for c in name:
                symbols.setdefault(c, size + len(symbols))
        ranks = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
        found = []
        for name, i in ids.items():
            for cut in range(1, len(name)):
                left, right = symbols.get(name[:cut]), symbols.get(name[cut:])
                if left is not None and right is not None:
                    found.append((left << 32 | right, ranks[scores[name]], i))
        self._store(found)
        self.of_character = {ord(name): i for name, i in symbols.items() if len(name) == 1}
        self.plane = np.full(0x110000, -1, dtype=np.int32)
        self.plane[list(self.of_character)] = list(self.of_character.values())
        # whether some piece holds two characters side by side, by numbers of the characters
        number = {c: i for i, c in enumerate(sorted(self.of_character), 1)}
        self.number = np.zeros(0x110000, dtype=np.int32)
        self.number[list(number)] = list(number.values())
        self.beside = np.zeros((len(number) + 1, len(number) + 1), dtype=bool)
        for name in ids:
            for a, b in zip(name, name[1:], strict=False):
                self.beside[number[ord(a)], number[ord(b)]] = True
        outside = [b"" if i in silent else bytes([int(n[1:-1], 16)]) if i in byte else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        for i in special - {*byte, *silent}:
            outside[i] = " ⁇ ".encode()
        self.lengths = np.array([len(b) for b in outside], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(outside), dtype=np.uint8)
        self.spaced = np.array([i not in special and n.startswith(SPACE) for i, n in enumerate(names)])
        self.quiet = np.zeros(size, dtype=bool)
        self.quiet[silent] = True
        self.words: Recent = Recent(self._encode_words, CACHE_BYTES)

    def _store(self, pairs: list[tuple[int, int, int]]) -> None:
        """Pairs (key, rank, merged) in a table with open addresses."""
        size = 1 << max(4, (8 * len(pairs)).bit_length() - 1)
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.keys = np.full(size, -1, dtype=np.int64)
        self.ranks = np.full(size, NEVER, dtype=np.int32)
        self.merged = np.zeros(size, dtype=np.int32)
        slots = self._slot(np.array([pair[0] for pair in pairs], dtype=np.int64)).tolist()
        for slot, (key, rank, made) in zip(slots, pairs, strict=True):
            while self.keys[slot] != -1:
                slot = (slot + 1) % size
            self.keys[slot], self.ranks[slot], self.merged[slot] = key, rank, made

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    @classmethod
    def of(cls, path: str) -> Vocabulary:
        if path not in cls.shared:
            cls.shared[path] = cls(path)
        return cls.shared[path]

    # --- encoding ------------------------------------------------------------------------------------------------

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        parts = [WORD.findall(SPACE + text.replace(" ", SPACE)) if text else [] for text in texts]
        return [np.frombuffer(ids, dtype=np.int32) for ids in self.words.joined(parts)]

    def _encode_words(self, words: list[str]) -> Iterator[bytes]:
        held, size = [], 0
        for word in words:
            held.append(word)
            size += len(word)
            if size >= CHARACTERS:
                yield from self._rounds(held)
                held, size = [], 0
        yield from self._rounds(held)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; NEVER where the vocabulary has none."""
        key = left.astype(np.int64) << 32 | right
        at = self._slot(key)
        other = np.flatnonzero((self.keys[at] != key) & (self.keys[at] != -1))
        while len(other):
            at[other] = (at[other] + 1) % len(self.keys)
            found = self.keys[at[other]]
            other = other[(found != key[other]) & (found != -1)]
        return self.ranks[at], self.merged[at]

    def _rounds(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        lengths = np.array([len(word) for word in words], dtype=np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        symbol = self.plane[points]
        symbol = np.where(symbol < 0, -1 - points, symbol).astype(np.int32)  # an unknown character keeps its code point
        number = self.number[points]
        new = np.ones(len(points), dtype=bool)
        new[1:] = (word[1:] != word[:-1]) | ~self.beside[number[:-1], number[1:]]
        segment = np.cumsum(new) - 1
        done: list[tuple[np.ndarray, np.ndarray]] = []  # places and symbols of finished segments
        sizes = np.bincount(segment)
        place = np.arange(len(points))
        for one in np.flatnonzero(sizes > LONG):
            mine = segment == one
            kept, symbols = self._queue(symbol[mine])
            done.append((place[mine][kept], symbols))
        leave = (sizes[segment] == 1) | (sizes[segment] > LONG)
        single = sizes[segment] == 1
        done.append((place[single], symbol[single]))
        place, symbol, segment = place[~leave], symbol[~leave], segment[~leave]
        rank, merged = self._ranked(symbol, segment)
        while len(symbol):
            start = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            count = np.diff(np.append(start, len(symbol)))
            best = np.repeat(np.minimum.reduceat(rank, start), count)
            open_ = best != NEVER
            if not open_.all():
                done.append((place[~open_], symbol[~open_]))
                place, symbol, segment, rank, merged, best = (a[open_] for a in (place, symbol, segment, rank, merged, best))
                if not len(symbol):
                    break
            at = self._chosen(symbol, segment, rank, merged, best)
            symbol[at] = merged[at]
            stay = np.ones(len(symbol), dtype=bool)
            stay[at + 1] = False
            at = (np.cumsum(stay) - 1)[at]
            place, symbol, segment, rank, merged = (a[stay] for a in (place, symbol, segment, rank, merged))
            touched = np.zeros(len(symbol), dtype=bool)
            touched[at] = touched[at[at > 0] - 1] = True
            touched = np.flatnonzero(touched)
            rank[touched], merged[touched] = self._ranked(symbol, segment, touched)
        return self._gather(words, word, done)

    def _ranked(self, symbol: np.ndarray, segment: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of the pairs that begin `at` (everywhere, if not given)."""
        at = np.arange(len(symbol)) if at is None else at
        after = np.minimum(at + 1, max(len(symbol) - 1, 0))
        rank, merged = self.pair(symbol[at], symbol[after])
        return np.where((segment[at] == segment[after]) & (after > at), rank, NEVER), merged

    def _chosen(self, symbol: np.ndarray, segment: np.ndarray, rank: np.ndarray, merged: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Where this round merges: every other one of adjoining best pairs, up to the first that puts a new pair before the others."""
        at = np.flatnonzero(rank == best)
        new = np.concatenate([[True], at[1:] != at[:-1] + 1])
        begins = at[new][np.cumsum(new) - 1]
        at = at[(at - begins) % 2 == 0]
        made = merged[at]
        before = np.maximum(at - 1, 0)
        left = symbol[before].copy()
        follows = np.flatnonzero(at[1:] == at[:-1] + 2) + 1  # what stands before is the symbol that the merge before made
        left[follows] = made[follows - 1]
        after = np.minimum(at + 2, len(symbol) - 1)
        first, _ = self.pair(left, made)
        second, _ = self.pair(made, symbol[after])
        first[(at == 0) | (segment[before] != segment[at])] = NEVER
        second[(at + 2 >= len(symbol)) | (segment[after] != segment[at])] = NEVER
        ends = np.minimum(first, second) <= best[at]
        if not ends.any():
            return at
        mine = segment[at]
        passed = np.cumsum(ends) - ends  # how many ends stand before
        opens = np.concatenate([[True], mine[1:] != mine[:-1]])
        base = passed[opens][np.cumsum(opens) - 1]
        return at[passed == base]

    def _queue(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same merges one by one, for one very long segment: places that stay, and their symbols."""
        symbol = symbols.tolist()
        n = len(symbol)
        following, preceding = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, merged = (a.tolist() for a in self.pair(symbols[:-1], symbols[1:]))
        queue = [(r, i, i + 1, m, symbol[i], symbol[i + 1]) for i, (r, m) in enumerate(zip(rank, merged, strict=True)) if r != NEVER]
        heapq.heapify(queue)
        known = {}
        while queue:
            _, i, j, made, a, b = heapq.heappop(queue)
            if symbol[i] != a or symbol[j] != b or following[i] != j:
                continue
            symbol[i], symbol[j] = made, None
            following[i] = following[j]
            if following[i] < n:
                preceding[following[i]] = i
            for left, right in ((preceding[i], i), (i, following[i])):
                if left >= 0 and right < n:
                    two = (symbol[left], symbol[right])
                    if two not in known:
                        r, m = self.pair(np.array(two[:1]), np.array(two[1:]))
                        known[two] = (int(r[0]), int(m[0]))
                    r, m = known[two]
                    if r != NEVER:
                        heapq.heappush(queue, (r, left, right, m, *two))
        kept = np.array([i for i in range(n) if symbol[i] is not None], dtype=np.int64)
        return kept, np.array([symbol[i] for i in kept], dtype=np.int32)

    def _gather(self, words: list[str], word: np.ndarray, done: list[tuple[np.ndarray, np.ndarray]]) -> list[bytes]:
        """Ids per word in the order of places; symbols that are no piece become the ids of their bytes."""
        place = np.concatenate([d[0] for d in done])
        symbol = np.concatenate([d[1] for d in done])
        order = np.argsort(place, kind="stable")
        of, symbol = word[place[order]], symbol[order]
        strange = np.flatnonzero((symbol < 0) | (symbol >= self.size))
        if len(strange):
            text = {i: c for c, i in self.of_character.items()}
            codes = {s: self.byte_ids[list(chr(-1 - s if s < 0 else text[s]).encode())] for s in set(symbol[strange].tolist())}
            repeats = np.ones(len(symbol), dtype=np.int64)
            repeats[strange] = [len(codes[s]) for s in symbol[strange].tolist()]
            fill = np.concatenate([codes[s] for s in symbol[strange].tolist()])
            odd = np.zeros(len(symbol), dtype=bool)
            odd[strange] = True
            of, symbol, odd = np.repeat(of, repeats), np.repeat(symbol, repeats), np.repeat(odd, repeats)
            symbol[odd] = fill
        ends = np.cumsum(np.bincount(of, minlength=len(words))) * 4
        data = symbol.astype(np.int32).tobytes()
        starts = np.concatenate([[0], ends[:-1]]).tolist()
        return [data[a:b] for a, b in zip(starts, ends.tolist(), strict=True)]

    # --- decoding ------------------------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: their bytes in one gather, without the space that encoding puts before a text."""
        if not len(ids):
            return ""
        quiet = np.flatnonzero(self.quiet[ids])
        if not len(quiet):
            return self._told(ids, True)
        told, out = True, []
        for part in np.split(ids, quiet):  # a control id says nothing, but ends a run of bytes
            part = part[1:] if len(part) and self.quiet[part[0]] else part
            if len(part):
                out.append(self._told(part, told))
                told = False
        return "".join(out)

    def _told(self, ids: np.ndarray, first: bool) -> str:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        inside = np.arange(int(ends[-1])) - np.repeat(ends - lengths, lengths)
        data = self.bytes[np.repeat(self.starts[ids], lengths) + inside].tobytes()
        text = data.decode("utf-8", "one_mark_a_byte")
        return text[1:] if first and self.spaced[ids[0]] else text


def _encoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(path)
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                some = batch.slice(start, TEXTS)
                ids = vocabulary.encode([text or "" for text in some.column(1).to_pylist()])
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                values = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([some.column(0), lists], names=["doc_id", "ids"])

    return run


def _decoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(path)
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                some = batch.slice(start, TEXTS)
                lists = some.column(1)
                values = lists.flatten().fill_null(0).to_numpy(zero_copy_only=False)
                ends = np.cumsum(np.array(lists.value_lengths().fill_null(0).to_pylist(), dtype=np.int64))
                pieces = np.split(values, ends[:-1]) if len(ends) else []
                text = pa.array([vocabulary.decode(p) for p in pieces], pa.string())
                yield pa.RecordBatch.from_arrays([some.column(0), lists, text], names=["doc_id", "ids", "text"])

    return run


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every row, as the library encodes with the model file: no begin or end ids, no sampling.

    A null text counts as empty and gives no ids; a null id stays null; repeated rows and rows that share an id give a row each; texts
    of any length and any characters are encoded whole (unknown characters as bytes). Other columns are not read, an empty table
    gives no rows. Rows stay in their partitions, and a lost task repeats only its own.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return arrow_batches(rows, _encoder(model), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, ids, text) of every row: the text that the library decodes from the ids.

    Null and empty lists give an empty text, null ids inside count as the unknown id 0, bytes that form no character give one
    replacement mark each. Ids outside of the vocabulary fail the job. Rows are treated one by one, as by `encode`.
    """
    rows = encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    return arrow_batches(rows, _decoder(model), "doc_id long, ids array<int>, text string")
