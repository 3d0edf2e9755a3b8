"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Every task tokenizes its own rows, each different word of a stretch of texts once, gathers blocks of about `BLOCK_WINDOWS` windows of tokens, and balances each block over its
windows: partial partitions are merged two at a time, the largest windows of one onto the smallest of the
other, always taking the two with the largest imbalance. If a window of the result exceeds the
capacity, the block is balanced again over one window more. Blocks are independent, so nothing is shuffled, a task holds
one block, and a lost task repeats only its own rows.
"""

from __future__ import annotations

import heapq
import os
from array import array
from bisect import insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import Recent, arrow_batches

CAPACITY = 2048
END = b"\x01\x00\x00\x00"  # id 1 closes a document
BLOCK_WINDOWS = 512
# One remainder in LADDER_EVERY is halved down to LADDER_LEAST ids; these small pieces level the windows.
LADDER_EVERY = 6
LADDER_LEAST = 8
LATIN = "\u024f"
# Latin letters that stay letters when they are composed or made small, with marks around that the tokenizer takes off anyway.
LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
PLAIN = rf"^(?P<lead>[\"(\[{{]*)(?P<letters>[{LETTERS}]+)(?P<tail>[!-/:-@\[-`{{-~]*)$"
LAST = "</w>"  # ends the last token of a word
JOINED = 256  # plain words that the tokenizer gets at a time
# What a worker remembers of other words and of their cores, each twice at most.
CACHE_BYTES = 12 << 20
# Bytes of text whose words are told apart at a time.
CHUNK_BYTES = 1 << 20

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def balance(sizes: list[int], windows: int) -> list[list[int]]:
    """Item numbers per window, by multiway differencing; at most `windows` lists, largest sum first."""
    heap: list[tuple[int, int, list[tuple[int, int, list]]]] = []
    for number, size in enumerate(sizes):
        heap.append((-size, number, [(-size, number, [number])]))
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        _, _, two = heapq.heappop(heap)
        if len(one) < len(two):
            one, two = two, one
        p, q = len(one), len(two)
        if p + q <= windows:
            if q == 1:
                insort(one, two[0])
                merged = one
            else:
                merged = sorted(one + two)
        else:
            merged = one[: windows - q] + two[: windows - p]
            for low, high in zip(one[windows - q :], reversed(two[windows - p :]), strict=True):
                merged.append((low[0] + high[0], low[1], low[2] + high[2]))
            merged.sort()
        spread = -merged[0][0] + (merged[-1][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, tie, merged))
        tie += 1
    return [items for _, _, items in heap[0][2]] if heap else []


def pack_block(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most `capacity`; the count rises until the largest fits."""
    windows = -(-sum(sizes) // capacity)
    while True:
        packed = balance(sizes, windows)
        if all(sum(sizes[i] for i in items) <= capacity for items in packed):
            return packed
        windows += 1


def cut(length: int, ladder: bool, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces: whole windows, then the remainder, in halves if it is a ladder."""
    pieces = [capacity] * (length // capacity)
    rest = length % capacity
    while ladder and rest > 2 * LADDER_LEAST:
        pieces.append(rest - rest // 2)
        rest //= 2
    return pieces + [rest] if rest else pieces


def core(word: str) -> list[str]:
    """Parts that the tokenizer takes apart anyway: a word of letters in lower case, and one mark behind it; any other word stays whole."""
    letters = word[:-1] if word[-1] in ".,;:!?" else word
    # Latin letters only: they hold no marks that could join with a letter, and stay letters when they are composed or made small (but for one)
    if not letters.isalpha() or not letters.isascii() and (max(letters) > LATIN or "İ" in letters):
        return [word]
    if "A" <= letters[0] <= "Z":
        letters = letters[0].lower() + letters[1:]
    return [letters, word[-1]] if len(letters) < len(word) else [letters]


def parts(word: str) -> list[str]:
    """Cores of what white space of any script leaves."""
    # Python splits at these four characters, the vocabulary doesn't
    return [word] if any(c in word for c in "\x1c\x1d\x1e\x1f") else [part for piece in word.split() for part in core(piece)]


def either(first: pa.Array, ones: pa.Array, others: pa.Array) -> pa.Array:
    """The next of `ones` where `first` holds, the next of `others` elsewhere."""
    mask = np.asarray(first)
    return pa.concat_arrays([ones, others]).take(pa.array(np.where(mask, np.cumsum(mask) - 1, len(ones) + np.cumsum(~mask) - 1)))


class Words:
    """Ids of texts, word by word: the vocabulary never joins across white space, so the different words of many texts are tokenized once.

    The letters of plain words go to the tokenizer in long rows, to the model alone if they are ASCII, since normalization changes nothing in them
    then. Any other word goes by itself; what a Python worker remembers of these is bounded in bytes, and words that are not met again make room.
    """

    shared: dict[str, Words] = {}

    def __init__(self, path: str, most: int = CACHE_BYTES) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.cores = Recent(self._encode, most)
        self.recent = Recent(lambda words: self.cores.joined([parts(word) for word in words]), most)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith(LAST)]] = True

    @classmethod
    def of(cls, path: str) -> Words:
        if path not in cls.shared:
            cls.shared[path] = cls(path)
        return cls.shared[path]

    def _encode(self, words: list[str]) -> Iterator[bytes]:
        for start in range(0, len(words), 20_000):
            for encoded in self.tokenizer.encode_batch_fast(words[start : start + 20_000], add_special_tokens=False):
                yield array("I", encoded.ids).tobytes()

    def _encode_rows(self, tokenizer: object, words: list[str]) -> pa.Array:
        """Ids of words of letters, told apart by the tokens that end a word."""
        flat, ends, before = [], [], 0
        for start in range(0, len(words), 16 * JOINED):
            rows = [words[at : at + JOINED] for at in range(start, min(start + 16 * JOINED, len(words)), JOINED)]
            for row, encoded in zip(rows, tokenizer.encode_batch_fast([" ".join(row) for row in rows], add_special_tokens=False), strict=True):
                ids = np.array(encoded.ids, "<u4")
                at = np.flatnonzero(self.closes[ids]) + 1
                if len(at) != len(row) or at[-1] != len(ids):  # another kind of vocabulary
                    return pa.array(self._encode(words), pa.large_binary())
                flat.append(ids)
                ends.append(at + before)
                before += len(ids)
        if not words:
            return pa.array([], pa.large_binary())
        offsets = 4 * np.concatenate([[0], *ends]).astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(flat))])

    def _letters(self, words: pa.Array) -> pa.Array:
        small = pc.string_is_ascii(words)
        one, other = (words.filter(mask).to_pylist() for mask in (small, pc.invert(small)))
        return either(small, self._encode_rows(self.plain, one), self._encode_rows(self.tokenizer, other))

    def _others(self, words: pa.Array) -> pa.Array:
        return pa.array(self.recent.joined([[word] for word in words.to_pylist()]), pa.large_binary())

    def _values(self, words: pa.Array) -> pa.Array:
        """Ids of each word."""
        found = pc.extract_regex(words, PLAIN)
        simple = pc.is_valid(found)
        plain = found.filter(simple)
        ways = {"lead": self._others, "letters": self._letters, "tail": self._others}
        values = []
        for name, encode in ways.items():
            told = pc.ascii_lower(pc.struct_field(plain, name)).dictionary_encode()
            values.append(encode(told.dictionary).take(told.indices))
        joined = pc.binary_join_element_wise(*values, pa.scalar(b"", pa.large_binary()))
        return either(simple, joined, self._others(words.filter(pc.invert(simple))))

    def ids(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Unsigned little-endian 32-bit ids of each text."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts)
        words = split.values.dictionary_encode()
        joined = self._values(words.dictionary).take(words.indices)
        _, offsets, data = joined.buffers()
        bounds = np.frombuffer(offsets, np.int64, len(joined) + 1)[np.asarray(split.offsets)].tolist()
        view = memoryview(data or b"")
        return [bytes(view[start:end]) for start, end in zip(bounds, bounds[1:])]


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Start and texts of stretches of about `most` bytes; null counts as empty."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64))
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most)) + 1
        yield start, texts.slice(start, end - start).cast(pa.large_string()).fill_null("")
        start = min(end, len(texts))


def _packer(path: str, capacity: int, block_windows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 33
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        words = Words.of(path)
        block: list[tuple] = []
        held = 0
        seen = 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for start, some in chunks(batch.column(1)):
                for key, ids in zip(keys[start : start + len(some)], words.ids(some), strict=True):
                    ids += END
                    total = len(ids) // 4
                    at = 0
                    for length in cut(total, seen % LADDER_EVERY == 0, capacity):
                        block.append((key, at, length, ids[4 * at : 4 * (at + length)], total))
                        at += length
                    held += total
                    seen += 1
                    if held >= block_windows * capacity:
                        out, sequence = _flush(block, sequence, capacity)
                        yield out
                        block, held = [], 0
        if block:
            yield _flush(block, sequence, capacity)[0]

    return run


def _flush(block: list[tuple], sequence: int, capacity: int) -> tuple[pa.RecordBatch, int]:
    packed = pack_block([piece[2] for piece in block], capacity)
    order, sequences, offsets = [], [], []
    for items in packed:
        offset = 0
        for item in items:
            order.append(item)
            sequences.append(sequence)
            offsets.append(offset)
            offset += block[item][2]
        sequence += 1
    rows = [block[item] for item in order]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)]
    columns += [pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())]
    names = [field.split()[0] for field in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays(columns, names), sequence


def pack(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    `ids` holds the piece's token ids as unsigned little-endian 32-bit integers; every document ends with id 1. Each
    input row gives its own pieces: repeated rows and rows that share an id are packed once each, a null text counts as empty and gives
    one piece with the end id, a null id stays null, and other columns are not read. An empty table gives no rows. A
    document may be of any length. Sequence ids are unique but not dense (task number and running number).
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return arrow_batches(rows, _packer(tokenizer, capacity, block_windows), PIECES)
