"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

A byte goes if a string of THRESHOLD bytes that covers it also starts in a document with a smaller id. Suffixes are ordered only up to
THRESHOLD bytes, most significant digit first, and only groups that could still be equal go on to the next pass:

1. Every window of THRESHOLD bytes has an anchor: its GRAM-byte string with the smallest hash (the leftmost of equals). Equal windows have
   equal anchors at equal places, so suffixes are ordered by their anchors first, and a window whose anchor occurs in one document only is
   no repetition. Neighbouring windows share an anchor, so one record stands for up to THRESHOLD - GRAM + 1 suffixes.
2. Second digit: all bytes that the windows of an anchor cover. Where they are equal, all those windows are repeated; equal records
   of a task are settled there and then, so that a passage that is everywhere is one record per task.
3. Windows whose anchors are equal and whose surroundings differ are ordered by their full THRESHOLD bytes. Groups of equal
   windows are exactly the repeated ones.

Digits are hashes, not bytes: records are compared by 40 bits of the anchor and 48 of the rest, within the part that further bits of the
anchor choose. A place is the first window's start and the number of windows, so that verdicts need no second look at a text's hashes.

Crowded anchors, which would fill a task, are dealt out by all their bytes instead: in the second pass by their surroundings, whose lowest ids
all stay open, and in the third by single windows, of which a task sends each once. A sample of the texts says which anchors are crowded; that
only decides which task judges a record, never how it is judged.

Verdicts travel packed, many documents to a row, by the documents' buckets; documents move once, by their key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import Stash, arrow_batches

THRESHOLD = 50
GRAM = 21
SPREAD = THRESHOLD - GRAM + 1  # grams in a window
INDEX_BITS = 28
# Texts are hashed in portions of about this size; longer ones in slices that overlap by a window.
CHUNK_BYTES = 1 << 20
HELD_RECORDS = 1_200_000
HELD_BYTES = 1 << 25
# Anchor records that one task of the second pass may hold, and bytes of text behind one record.
TASK_RECORDS = 1_500_000
BYTES_PER_RECORD = 15
# Bytes of text per task that reads documents, and the most buckets that verdicts are packed by.
TASK_BYTES = 24 << 20
BUCKETS = 4096
# An anchor met CROWD times in the sample is crowded. From SAMPLE_BYTES on the sample is a part of the texts, but never less than one in SAMPLE_LEAST.
# Fewer than MOST_CROWDED anchors can each hold more than one in MOST_CROWDED records.
CROWD = 50
SAMPLE_BYTES = 8 << 20
SAMPLE_LEAST = 15_000
MOST_CROWDED = 1_000_000
LAST = (1 << 63) - 1  # stands for a null id


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


@dataclass
class Anchors:
    """One entry per anchor: its piece (place in the list), first window start there and in the joined bytes, number of windows, hashes."""

    piece: np.ndarray
    low: np.ndarray
    begin: np.ndarray
    width: np.ndarray
    gram: np.ndarray
    context: np.ndarray
    windows: np.ndarray  # hash of the window at every joined byte


def anchors(pieces: list[bytes]) -> Anchors:
    """Anchors of all windows of the pieces."""
    lens = np.array([len(d) for d in pieces], dtype=np.int64)
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    empty = np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lens)
    if len(data) < THRESHOLD:
        none = np.zeros(0, dtype=np.uint64)
        return Anchors(empty, empty, empty, empty, none, none, none)
    h = {1: (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407)}

    def longer(n: int, m: int) -> None:
        size = len(data) - n - m + 1
        h[n + m] = _mix(h[n][:size], h[m][n : n + size])

    for n in (1, 2, 4, 8):
        longer(n, n)
    longer(16, 4)
    longer(20, 1)
    gram = h[GRAM]
    low_bits = np.uint64((1 << INDEX_BITS) - 1)
    least = (gram & ~low_bits) | np.arange(len(gram), dtype=np.uint64)
    have = 1
    while have < SPREAD:
        step = min(have, SPREAD - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    piece = np.repeat(np.arange(len(lens)), lens)[: len(least)]
    start = np.arange(len(least))
    inside = start + THRESHOLD <= ends[piece]
    start, piece = start[inside], piece[inside]
    chosen = (least[inside] & low_bits).astype(np.int64)
    cuts = np.flatnonzero(np.r_[len(start) > 0, (chosen[1:] != chosen[:-1]) | (piece[1:] != piece[:-1])])
    low, high = start[cuts], start[np.r_[cuts[1:], len(start)].astype(np.int64) - 1] if len(cuts) else empty
    piece, at = piece[cuts], chosen[cuts]
    longer(16, 16)
    longer(32, 16)
    longer(48, 2)
    windows = h[THRESHOLD]
    shape = ((at - low) * 64 + (high - low)).astype(np.uint64)
    context = _mix(_mix(windows[low], windows[high]), shape)
    return Anchors(piece, low - (ends - lens)[piece], low, high - low + 1, gram[at], context, windows)


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Portions of texts: for each piece its text's index and where it starts there. Every window lies in exactly one piece."""
    owners: list[int] = []
    offsets: list[int] = []
    pieces: list[bytes] = []
    size = 0
    for k, text in enumerate(texts):
        for start in range(0, max(1, len(text) - THRESHOLD + 1), CHUNK_BYTES):
            piece = text[start : start + CHUNK_BYTES + THRESHOLD - 1] if len(text) > CHUNK_BYTES else text
            owners.append(k)
            offsets.append(start)
            pieces.append(piece)
            size += len(piece)
            if size >= CHUNK_BYTES:
                yield np.array(owners), np.array(offsets), pieces
                owners, offsets, pieces, size = [], [], [], 0
    if pieces:
        yield np.array(owners), np.array(offsets), pieces


def _places(found: Anchors, offsets: np.ndarray) -> np.ndarray:
    """Each anchor's first window start in its text and number of windows, in 40 bits."""
    return ((found.low + offsets[found.piece]) * 32 + found.width - 1).astype(np.uint64)


def _narrow(values: np.ndarray, size: int) -> bytes:
    """The low `size` bytes of unsigned 64-bit values."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _widen(data: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), dtype=np.uint8)
    out[:, :size] = data.reshape(-1, size)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values."""
    if not len(columns[0]):
        return np.zeros(0, dtype=np.int64)
    change = np.zeros(len(columns[0]), dtype=bool)
    change[0] = True
    for column in columns:
        change[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(change)


def _lengths(begin: np.ndarray, total: int) -> np.ndarray:
    return np.diff(np.r_[begin, total])


def _lowest(ids: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For each row the lowest id among the rows with equal keys."""
    order = np.lexsort((ids, *keys))
    begin = _runs(*[key[order] for key in keys])
    out = np.empty_like(ids)
    out[order] = np.repeat(ids[order][begin], _lengths(begin, len(ids)))
    return out


# A packed row: number of records and of document runs, then per run id, mark and length, then the columns of the records.
def _pack(ids: np.ndarray, marks: np.ndarray, *columns: tuple[np.ndarray, int]) -> bytes:
    begin = _runs(ids, marks)
    counts = _lengths(begin, len(ids))
    parts = [np.array([len(ids), len(begin)], dtype="<u4").tobytes(), ids[begin].astype("<i8").tobytes(), marks[begin].astype("<i4").tobytes(), counts.astype("<u4").tobytes()]
    return b"".join(parts + [_narrow(values, size) for values, size in columns])


def _unpack(blob: bytes, sizes: tuple[int, ...]) -> tuple[list[np.ndarray], int]:
    n, runs = np.frombuffer(blob, dtype="<u4", count=2)
    at = 8
    ids = np.frombuffer(blob, dtype="<i8", count=runs, offset=at)
    at += 8 * int(runs)
    marks = np.frombuffer(blob, dtype="<i4", count=runs, offset=at)
    at += 4 * int(runs)
    counts = np.frombuffer(blob, dtype="<u4", count=runs, offset=at)
    at += 4 * int(runs)
    out = [np.repeat(ids, counts), np.repeat(marks, counts)]
    for size in sizes:
        out.append(_widen(np.frombuffer(blob, dtype=np.uint8, count=int(n) * size, offset=at), size))
        at += int(n) * size
    return out, at


def _unpack_all(blobs: list[bytes], sizes: tuple[int, ...]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*[_unpack(b, sizes)[0] for b in blobs], strict=True)]


SCHEMA = "kind int, part int, data binary"
# Verdicts on whole anchors and on some of their windows, anchors that are still open; records of common and of crowded anchors.
FULL, SOME, OPEN, RECORDS, CROWDED = range(5)
SIZES = {FULL: (5,), SOME: (5, 4), OPEN: (5,), RECORDS: (5, 6, 5), CROWDED: (5, 6, 5)}
WINDOWS = (5, 5, 1, 1)  # key, place, first window and number of windows, before the windows' hashes


class _Rows:
    """Rows of SCHEMA that become batches of bounded size."""

    def __init__(self) -> None:
        self.columns: list[list] = [[], [], []]
        self.size = 0

    def add(self, kind: int, part: int, data: bytes) -> None:
        for column, value in zip(self.columns, (kind, part, data), strict=True):
            column.append(value)
        self.size += len(data) + 40

    def verdicts(self, kind: int, buckets: int, ids: np.ndarray, marks: np.ndarray, *columns: np.ndarray) -> None:
        """One row per bucket of documents."""
        if not len(ids):
            return
        bucket = (_mix(ids.view(np.uint64), marks.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((columns[0], marks, ids, bucket))
        for some in np.split(order, _runs(bucket[order])[1:]):
            packed = [(c[some], size) for c, size in zip(columns, SIZES[kind], strict=True)]
            self.add(kind, int(bucket[some[0]]), _pack(ids[some], marks[some], *packed))

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), pa.binary()]
        out = pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(self.columns, kinds, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")]
        )
        self.columns, self.size = [[], [], []], 0
        return out


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, pieces in _pieces(batch.column(0).to_pylist()):
            grams, counts = np.unique(anchors(pieces).gram, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(counts, pa.int64())], ["gram", "n"])


def crowded_anchors(rows: DataFrame, size: int) -> np.ndarray:
    """Anchors that the sampled texts hold CROWD times, in order."""
    share = min(1.0, max(SAMPLE_BYTES / max(size, 1), 1 / SAMPLE_LEAST))
    sample = rows.where(F.pmod(F.xxhash64("id", "mark", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))
    counted = arrow_batches(sample.select("text"), _count_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") >= CROWD).orderBy(F.desc("n"), "gram").limit(MOST_CROWDED).select("gram").toArrow()
    return np.sort(found.column("gram").to_numpy().view(np.uint64))


def _first_pass(parts: int, buckets: int, crowded: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        rows = _Rows()

        def settle() -> Iterator[pa.RecordBatch]:
            ids, marks, places, grams, contexts = (np.concatenate(c) for c in zip(*held, strict=True))
            later = ids > _lowest(ids, contexts, grams)
            rows.verdicts(FULL, buckets, ids[later], marks[later], places[later])
            ids, marks, places, grams, contexts = (c[~later] for c in (ids, marks, places, grams, contexts))
            dealt = np.isin(grams, crowded)
            keys = np.where(dealt, _mix(grams, contexts), grams)
            part = (keys % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((places, marks, ids, dealt, part))
            for some in np.split(order, _runs(part[order], dealt[order])[1:]):
                if len(some):
                    columns = [(keys[some] // np.uint64(parts), 5), (contexts[some], 6), (places[some], 5)]
                    rows.add(CROWDED if dealt[some[0]] else RECORDS, int(part[some[0]]), _pack(ids[some], marks[some], *columns))
                if rows.size > 1 << 23:
                    yield rows.batch()
            yield rows.batch()

        for batch in batches:
            all_ids, all_marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for owners, offsets, pieces in _pieces(batch.column(2).to_pylist()):
                found = anchors(pieces)
                at = owners[found.piece]
                held.append((all_ids[at], all_marks[at], _places(found, offsets), found.gram, found.context))
                count += len(at)
                if count >= HELD_RECORDS:
                    yield from settle()
                    held, count = [], 0
        if count:
            yield from settle()

    return run


def _by_part(batches: Iterator[pa.RecordBatch], rows: _Rows) -> Iterator[tuple[int, list[bytes]]]:
    """Kind and packed records of one part after the other (the input is sorted by part and kind); verdicts pass."""
    last, held = None, []
    for batch in batches:
        for kind, part, blob in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            if kind in (FULL, SOME, OPEN):
                rows.add(kind, part, blob)
                continue
            if (part, kind) != last and held:
                yield last[1], held
                held = []
            last = (part, kind)
            held.append(blob)
        yield -1, []
    if held:
        yield last[1], held


def _second_pass(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows()
        for kind, blobs in _by_part(batches, rows):
            if blobs:
                ids, marks, keys, contexts, places = _unpack_all(blobs, SIZES[kind])
                order = np.lexsort((ids, contexts, keys))
                ids, marks, keys, contexts, places = (c[order] for c in (ids, marks, keys, contexts, places))
                inner = _runs(keys, contexts)
                lowest = np.repeat(ids[inner], _lengths(inner, len(ids)))
                later, unsure = ids > lowest, ids == lowest
                if kind == RECORDS:
                    group = _runs(keys)
                    sizes = _lengths(group, len(ids))
                    several = np.repeat(np.minimum.reduceat(ids, group) != np.maximum.reduceat(ids, group), sizes)
                    opens = np.zeros(len(ids), dtype=np.int64)
                    opens[inner] = 1
                    unsure &= several & np.repeat(np.add.reduceat(opens, group) > 1, sizes)
                rows.verdicts(FULL, buckets, ids[later], marks[later], places[later])
                rows.verdicts(OPEN, buckets, ids[unsure], marks[unsure], places[unsure])
            if rows.size > 1 << 22:
                yield rows.batch()
        yield rows.batch()

    return run


GATHERED = "kind int, id long, mark int, data binary"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verdicts taken apart again: one row per document and kind, or a few where a bucket exceeds HELD_BYTES."""
    held: dict[int, list[bytes]] = {FULL: [], SOME: [], OPEN: []}

    def settle() -> Iterator[pa.RecordBatch]:
        for kind, blobs in held.items():
            if not blobs:
                continue
            ids, marks, *columns = _unpack_all(blobs, SIZES[kind])
            order = np.lexsort((columns[0], marks, ids))
            begin = _runs(ids[order], marks[order])
            packed = [(_narrow(c[order], size), size) for c, size in zip(columns, SIZES[kind], strict=True)]
            data = [
                b"".join(values[size * a : size * b] for values, size in packed)
                for a, b in zip(begin.tolist(), np.r_[begin[1:], len(order)].tolist(), strict=True)
            ]
            first = order[begin]
            arrays = [pa.array([kind] * len(data), pa.int32()), pa.array(ids[first]), pa.array(marks[first]), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["kind", "id", "mark", "data"])
            blobs.clear()

    size = 0
    for batch in batches:
        for kind, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            held[kind].append(blob)
            size += len(blob)
            if size >= HELD_BYTES:
                yield from settle()
                size = 0
    yield from settle()


def _window_pass(parts: int, buckets: int, crowded: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs the full windows of the anchors that are still open: columns id, mark, text, open places (list of binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        rows = _Rows()

        def settle() -> Iterator[pa.RecordBatch]:
            ids, marks, places, grams, widths, hashes = (np.concatenate(c) for c in zip(*held, strict=True))
            begin = np.cumsum(widths) - widths
            firsts = np.zeros(len(ids), dtype=np.int64)
            dealt = np.flatnonzero(np.isin(grams, crowded))
            if len(dealt):
                owner = np.repeat(dealt, widths[dealt])
                bit = np.arange(len(owner)) - np.repeat(np.cumsum(widths[dealt]) - widths[dealt], widths[dealt])
                single = _mix(grams[owner], hashes[begin[owner] + bit])
                later = ids[owner] > _lowest(ids[owner], single)
                on = owner[later]
                rows.verdicts(SOME, buckets, ids[on], marks[on], places[on], np.uint64(1) << bit[later].astype(np.uint64))
                owner, bit, single = owner[~later], bit[~later], single[~later]
                whole = np.ones(len(ids), dtype=bool)
                whole[dealt] = False
                ids, marks, places = (np.r_[c[whole], c[owner]] for c in (ids, marks, places))
                begin, firsts = np.r_[begin[whole], begin[owner] + bit], np.r_[firsts[whole], bit]
                widths, keys = np.r_[widths[whole], np.ones(len(owner), dtype=np.int64)], np.r_[grams[whole], single]
            else:
                keys = grams
            part = (keys % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((places, marks, ids, part))
            for some in np.split(order, _runs(part[order])[1:]):
                if len(some):
                    values = (keys[some] // np.uint64(parts), places[some], firsts[some].astype(np.uint64), widths[some].astype(np.uint64))
                    blob = _pack(ids[some], marks[some], *zip(values, WINDOWS, strict=True))
                    inside = np.repeat(begin[some] - (np.cumsum(widths[some]) - widths[some]), widths[some]) + np.arange(widths[some].sum())
                    rows.add(RECORDS, int(part[some[0]]), blob + _narrow(hashes[inside], 6))
                if rows.size > 1 << 23:
                    yield rows.batch()
            yield rows.batch()

        for batch in batches:
            all_ids, all_marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            wanted = [np.unique(_widen(np.frombuffer(b"".join(some), dtype=np.uint8), 5)) for some in batch.column(3).to_pylist()]
            for owners, offsets, pieces in _pieces(batch.column(2).to_pylist()):
                found = anchors(pieces)
                places = _places(found, offsets)
                edges = np.searchsorted(found.piece, np.arange(len(pieces) + 1))
                on = np.concatenate([a + np.flatnonzero(np.isin(places[a:b], wanted[k])) for k, a, b in zip(owners, edges[:-1], edges[1:], strict=True)])
                widths = found.width[on]
                inside = np.repeat(found.begin[on] - (np.cumsum(widths) - widths), widths) + np.arange(widths.sum())
                at = owners[found.piece[on]]
                held.append((all_ids[at], all_marks[at], places[on], found.gram[on], widths, found.windows[inside]))
                count += int(widths.sum())
                if count >= 4 * HELD_RECORDS:
                    yield from settle()
                    held, count = [], 0
        if count:
            yield from settle()

    return run


def _third_pass(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Orders open windows by all their bytes; a verdict says, bit by bit, which windows of an anchor are repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows()
        for _, blobs in _by_part(batches, rows):
            if blobs:
                columns: list[list[np.ndarray]] = [[], [], [], [], [], [], []]
                for blob in blobs:
                    head, at = _unpack(blob, WINDOWS)
                    hashes = _widen(np.frombuffer(blob, dtype=np.uint8, offset=at), 6)
                    for column, values in zip(columns, [*head, hashes], strict=True):
                        column.append(values)
                ids, marks, keys, places, firsts, widths, hashes = (np.concatenate(c) for c in columns)
                widths = widths.astype(np.int64)
                owner = np.repeat(np.arange(len(ids)), widths)
                bit = np.arange(len(owner)) - np.repeat(np.cumsum(widths) - widths - firsts.astype(np.int64), widths)
                on = np.flatnonzero(ids[owner] > _lowest(ids[owner], hashes, keys[owner]))
                masks = np.zeros(len(ids), dtype=np.uint64)
                np.bitwise_or.at(masks, owner[on], np.uint64(1) << bit[on].astype(np.uint64))
                hit = np.flatnonzero(masks)
                rows.verdicts(SOME, buckets, ids[hit], marks[hit], places[hit], masks[hit])
            if rows.size > 1 << 22:
                yield rows.batch()
        yield rows.batch()

    return run


def repeated_bytes(size: int, full: list[bytes], some: list[bytes]) -> np.ndarray:
    """Booleans per byte of a text of `size` bytes: covered by a repeated window."""
    starts = np.zeros(size + 1, dtype=np.int32)
    places = np.unique(_widen(np.frombuffer(b"".join(full), dtype=np.uint8), 5)).astype(np.int64)
    np.add.at(starts, places >> 5, 1)
    np.add.at(starts, (places >> 5) + (places & 31) + THRESHOLD, -1)
    for blob in some:
        data, n = np.frombuffer(blob, dtype=np.uint8), len(blob) // 9
        low, masks = _widen(data[: 5 * n], 5).astype(np.int64) >> 5, _widen(data[5 * n :], 4)
        for begin in range(0, n, 1 << 16):
            bits = (masks[begin : begin + (1 << 16), None] >> np.arange(SPREAD, dtype=np.uint64)) & np.uint64(1)
            entry, bit = np.nonzero(bits)
            at = low[begin + entry] + bit
            np.add.at(starts, at, 1)
            np.add.at(starts, at + THRESHOLD, -1)
    return np.cumsum(starts[:size], dtype=np.int32) > 0


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, stop: long>>, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns id, mark, text, doc_id, full, some."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), span, pa.binary()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        held = 0
        for text, doc_id, full, some in zip(*[batch.column(k).to_pylist() for k in range(2, 6)], strict=True):
            spans: list[dict] = []
            kept, removed = text, 0
            if full or some:
                gone = repeated_bytes(len(text), full or [], some or [])
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                spans = [{"start": a, "stop": b} for a, b in edges.reshape(-1, 2).tolist()]
                removed = int(gone.sum())
                kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
            for column, value in zip(out, (doc_id, len(text), removed, len(spans), spans, kept), strict=True):
                column.append(value)
            held += len(kept)
            if held >= HELD_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)
                out, held = [[], [], [], [], [], []], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)


def _dealt(packed: DataFrame, parts: int) -> DataFrame:
    return packed.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: doc_id, n_bytes, n_removed, n_spans, the removed spans (byte offsets), and the remaining bytes.

    Null texts count as empty; texts below THRESHOLD bytes stay whole. Rows that share an id never remove each other's bytes, repeated rows have
    equal results. A null id counts as the largest one. Other columns are not read; an empty table gives no rows. Texts may have any length that a
    column value can have; long ones are hashed in slices.
    """
    stash = Stash(docs.sparkSession, "suffixes")
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(content).cast("string").substr(-9, 9).cast("int").alias("mark"),
        content.cast("binary").alias("text"), F.col(doc_id).cast("long").alias("doc_id"),
    )
    size = docs.agg(F.sum(F.octet_length(content))).first()[0] or 0
    parts = max(4, -(-size // (BYTES_PER_RECORD * TASK_RECORDS)))
    spread = max(4, size // TASK_BYTES)
    buckets = min(spread, BUCKETS)
    crowded = crowded_anchors(rows, size)

    def by_document(verdicts: DataFrame) -> DataFrame:
        return arrow_batches(verdicts.repartitionById(buckets, F.col("part")), _gather, GATHERED)

    records = arrow_batches(rows.select("id", "mark", "text"), _first_pass(parts, buckets, crowded), SCHEMA)
    settled = stash.put(arrow_batches(_dealt(records, parts), _second_pass(buckets), SCHEMA))
    placed = rows.repartition(spread, "id", "mark")
    unsure = by_document(settled.where(F.col("kind") == OPEN)).groupBy("id", "mark").agg(F.collect_list("data").alias("places"))
    opened = placed.join(unsure, ["id", "mark"]).select("id", "mark", "text", "places")
    windows = arrow_batches(opened, _window_pass(parts, buckets, crowded), SCHEMA)
    masks = arrow_batches(_dealt(windows, parts), _third_pass(buckets), SCHEMA)
    whole = F.col("kind") == FULL
    verdicts = (
        by_document(settled.where(whole).union(masks))
        .groupBy("id", "mark")
        .agg(F.collect_list(F.when(whole, F.col("data"))).alias("full"), F.collect_list(F.when(~whole, F.col("data"))).alias("some"))
    )
    judged = placed.join(verdicts, ["id", "mark"], "left").select("id", "mark", "text", "doc_id", "full", "some")
    return arrow_batches(judged, _cut, RESULT)
