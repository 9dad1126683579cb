"""Removal of repeated passages: bytes of 100-byte strings that also start earlier.

A repeated string of 100 bytes is found from one marked place inside it: the
least of the hashes of its 24-byte runs (a minimiser), which is the same wherever
the string occurs. So each window of 100 bytes belongs to one mark, consecutive
windows share marks, and marks that occur once in the corpus end the search for
all their windows. What is left is compared in these steps.

1. Tasks reduce their own marks: of marks with the same surroundings all but the
   first are decided at once; the others are dealt by hash, where the same is done
   over all tasks and marks that occur once disappear.
2. Marks with several different surroundings are looked at again in their texts.
   The windows of a mark are taken in pieces of 20, which share a core of 81
   bytes; a piece is the hash of its core and the bytes beyond it on both sides.
   Pieces whose core occurs once disappear in the same way.
3. Each task is a shard that ships its pieces in sorted order, by what stands right
   of the core and by what stands left of it. The shards' orders are merged by
   interleave refinement, which gives common prefixes; windows of two pieces are
   equal if both common prefixes reach far enough.
4. Cores that meet many different surroundings within one task (a passage's ends,
   in whatever it is pasted into) are crowded: no task gathers all of their pieces.
   They are dealt by their bytes, and what remains as one row a window, dealt by
   the window's hash. Groups that grow beyond GROUP different rows only where all
   tasks meet go the same way, as they come: no task holds more than that of one
   mark or core, though a task reads up to FEW_KINDS rows of a mark, and KINDS of
   a core, from each HELD rows of another.
5. Each text's decided windows are united and cut out.

Every step makes rows in proportion to those before it, at most 4 pieces a mark
and 20 windows a piece. Full Burrows-Wheeler transforms of all suffixes aren't
built: README.md has figures. Texts are moved only where they hold repeated marks.

Defined results: a null or empty text has no bytes; texts under 100 bytes lose
nothing; rows that share an id are told apart by their text, in the order of its
hash, equal rows being one document with one result; null ids come first; texts
of any length are used whole; an empty table gives an empty result; other columns
are ignored. Surroundings and cores are equal if their 64-bit hashes are, among
those that share a mark; bytes beyond cores are compared themselves in step 3, and
by a second 64-bit hash in step 4.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mensura.llm._store import bounded, cut, frugal, table
from mensura.llm._text import Slice, hash_words, mix, slices
from mensura.llm.interleave import classes, merge

LENGTH = 100
RUN = 24
SPAN = LENGTH - RUN + 1
HELD = 1 << 18
MARK_SLICE = 1 << 20
STEP = 20
CORE = LENGTH - STEP + 1
EXT = 2 * STEP  # STEP - 1 bytes on each side and two for the range of windows
FEW_KINDS = 4
KINDS = 32
GROUP = 4096
CHUNK = 16_384
BROADCAST_IDS = 1_000_000
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def marks(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first window, number of windows, place of the mark and its hash, for each mark of a slice."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    n = len(s.data)
    if n < LENGTH:
        return none
    eight = np.ndarray(n - 7, "<u8", s.data.tobytes(), 0, (1,))
    m = n - RUN + 1
    runs = eight[:m] * _C[0]
    for k in (1, 2):
        runs += eight[8 * k : 8 * k + m] * _C[k]
    runs = mix(runs)
    bits = np.uint64(max(22, int(n).bit_length()))
    keyed = (runs >> bits << bits) | np.arange(m, dtype=np.uint64)
    least, width = keyed, 1
    while width * 2 <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: m - SPAN + 1], least[SPAN - width :][: m - SPAN + 1])
    place = (least & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    # windows that don't leave their text
    sizes = np.diff(s.offsets)
    text = np.repeat(np.arange(len(s)), np.maximum(sizes - LENGTH + 1, 0))
    if not len(text):
        return none
    before = np.concatenate([[0], np.cumsum(np.maximum(sizes - LENGTH + 1, 0))])
    window = np.arange(len(text)) - before[text] + s.offsets[text]
    place = place[window]
    new = np.ones(len(text), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(text)))
    return text[first], window[first], many, place[first], runs[place[first]]


def _at(x0, many, offset) -> np.ndarray:
    """First window, number of windows and the mark's distance from the first, as one integer."""
    return (x0 << 16) | (many << 8) | offset


def _parts(at: np.ndarray):
    return at >> 16, (at >> 8) & 255, at & 255


def _joined(doc: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Intervals (doc, a, b), those that touch united."""
    if not len(doc):
        return doc, a, b
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    # running end within a doc: docs are set apart by an offset larger than any end
    step = int(b.max()) + 1
    rank = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    reach = np.maximum.accumulate(b + rank * step) - rank * step
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (a[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], a[first], reach[last]


class _Held:
    """Columns of rows that a task gathers, taken together when there are many."""

    def __init__(self, most: int):
        self.most, self.parts, self.n = most, [], 0

    def add(self, *columns: np.ndarray) -> bool:
        """Whether it is time to take them."""
        self.parts.append(columns)
        self.n += len(columns[0])
        return self.n >= self.most

    def take(self) -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*self.parts)]
        self.parts, self.n = [], 0
        return columns


def _new(*keys: np.ndarray) -> np.ndarray:
    """Where any of the keys differs from the row before."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _of_each(starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sum of ``values`` over each run that begins where ``starts`` holds, for every row."""
    return np.add.reduceat(values.astype(np.int64), np.flatnonzero(starts))[np.cumsum(starts) - 1] if len(starts) else np.zeros(0, np.int64)


def _reduced(h, s, doc, at, kinds: int):
    """What one task can say of its rows: the later ones of each (h, s); the first ones; which of these have an h with more than ``kinds`` values of s."""
    order = np.lexsort((at, doc, s, h))
    first = _new(h[order], s[order])
    keep = order[first]
    return order[~first], keep, _of_each(_new(h[keep]), np.ones(len(keep), bool)) > kinds


#: Kinds of rows. SINGLE ones are dealt by h, with all kinds of that h. Those of a
#: CROWDED h (one with many values of s in one task) are dealt by (h, s), and one row
#: without a place tells those that are dealt by h of it. DECIDED ones are intervals.
SINGLE, CROWDED, DECIDED = 0, 1, 2
NO_PLACE = -1
ROWS = "kind int, h long, s long, doc long, at long"
PIECES = ROWS + ", shard long, by_right int, by_left int, ext binary"
DEAL = "CASE WHEN kind = 1 THEN xxhash64(h, s) ELSE h END"


def _rows(kind, h, s, doc, at, **more) -> pa.RecordBatch:
    kinds = np.full(len(h), kind, np.int32) if np.isscalar(kind) else np.asarray(kind, np.int32)
    return pa.record_batch({"kind": pa.array(kinds), **{k: pa.array(v, pa.int64()) for k, v in zip(("h", "s", "doc", "at"), (h, s, doc, at))}, **more})


def _intervals(doc, a, b):
    """Decided intervals in the form of rows: h is free, s the end and ``at`` the start."""
    doc, a, b = _joined(doc, a, b)
    return DECIDED, mix(doc.astype(np.uint64)).view(np.int64), b, doc, a


def _told(h: np.ndarray):
    """Rows that tell of crowded values of h."""
    h = np.unique(h)
    return SINGLE, h, np.zeros_like(h), np.zeros_like(h), np.full(len(h), NO_PLACE)


def _pieces(s: Slice) -> Iterator[tuple[Slice, int]]:
    """A slice, or the parts of one very long text, with where each begins; every window lies in one part."""
    if len(s) > 1 or len(s.data) <= 2 * MARK_SLICE:
        yield s, 0
        return
    for at in range(0, len(s.data) - LENGTH + 1, MARK_SLICE):
        part = s.data[at : at + MARK_SLICE + LENGTH - 1]
        yield Slice(part, np.array([0, len(part)]), s.rows), at


def _mark(held: int, kinds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = _Held(held)

        def out():
            h, s, doc, at = gathered.take()
            lost, keep, crowd = _reduced(h, s, doc, at, kinds)
            x0, many, _ = _parts(at[lost])
            yield _rows(*_intervals(doc[lost], x0, x0 + many - 1 + LENGTH))
            yield _rows(*_told(h[keep[crowd]]))
            for i in range(0, len(keep), 50_000):
                k = keep[i : i + 50_000]
                yield _rows(crowd[i : i + 50_000], h[k], s[k], doc[k], at[k])

        for batch in batches:
            docs = batch.column("doc").to_numpy()
            for whole in slices(batch.column("text"), MARK_SLICE):
                for s, begin in _pieces(whole):
                    text, x0, many, place, h = marks(s)
                    offset = place - x0
                    around = mix(hash_words(s.data, x0, x0 + many - 1 + LENGTH) + offset.astype(np.uint64))
                    at = _at(x0 - s.offsets[text] + begin, many, offset)
                    if gathered.add(h.view(np.int64), around.view(np.int64), docs[s.rows.start + text], at):
                        yield from out()
        if gathered.n:
            yield from out()

    return run


def _settled(batches: Iterator[pa.RecordBatch], columns: tuple, later, single, large, crowded, decided, most: int) -> Iterator[pa.RecordBatch]:
    """Goes through rows sorted by (kind, h, s, doc, at).

    Of SINGLE rows ``later`` gets those that aren't the first of their (h, s), at
    once, ``single`` the first ones, all of an h together with which h were told of,
    and ``large`` the first ones of an h that has more than ``most`` of them, as they
    come. ``crowded`` gets CROWDED rows with which of them are the first of their
    (h, s), and ``decided`` the others. What is held back are ``most`` rows of the
    last h at most, or the last (h, s), however many rows a task gets of one h.
    """
    held, told, last_of, beyond, last = None, None, None, None, None
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        all_ = [_fixed(batch.column(c)) if c == "ext" else batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        own = [c[kind == SINGLE] for c in all_]
        if len(own[0]):
            place = own[3] != NO_PLACE
            first = _new(own[0], own[1], place)
            first[0] &= last_of != (own[0][0], own[1][0], place[0])
            last_of = (own[0][-1], own[1][-1], place[-1])
            yield from later(*(c[place & ~first] for c in own))
            tell = np.unique(own[0][~place])
            told = tell if told is None else np.concatenate([told, tell])
            own = [c[place & first] for c in own]
            gone = own[0] == beyond
            if gone.any():
                yield from large(*(c[gone] for c in own))
                own = [c[~gone] for c in own]
        if len(own[0]):
            if held is not None:
                own = [np.concatenate(x) for x in zip(held, own)]
            held = None
            end = int(np.searchsorted(own[0], own[0][-1], "left")) if not (kind != SINGLE).any() else len(own[0])
            if len(own[0]) - end > most:
                beyond = own[0][-1]
                yield from large(*(c[end:] for c in own))
            elif end < len(own[0]):
                held = [c[end:] for c in own]
            if end:
                yield from single(told, *(c[:end] for c in own))
            told = told[told >= own[0][-1]]
        own = [c[kind == CROWDED] for c in all_]
        if len(own[0]):
            first = _new(own[0], own[1])
            first[0] &= last != (own[0][0], own[1][0])
            last = (own[0][-1], own[1][-1])
            yield from crowded(first, *own)
        own = [c[kind == DECIDED] for c in all_]
        if len(own[0]):
            yield from decided(*own[:4])
    if held is not None:
        yield from single(told, *held)


def _decide(most: int):
    """Marks by (kind, h, s, doc, at): intervals, and the marks whose surroundings have to be looked at."""

    def later(h, s, doc, at):
        x0, many, _ = _parts(at)
        yield _rows(*_intervals(doc, x0, x0 + many - 1 + LENGTH))

    def large(h, s, doc, at):
        yield _rows(SINGLE, h, s, doc, at)

    def single(told, h, s, doc, at):
        new = _new(h)
        several = (_of_each(new, np.ones(len(h), bool)) > 1) | np.isin(h, told)
        yield from large(h[several], s[several], doc[several], at[several])

    def crowded(first, h, s, doc, at):
        yield from later(h[~first], s[~first], doc[~first], at[~first])
        yield from large(h[first], s[first], doc[first], at[first])

    def decided(h, s, doc, at):
        yield _rows(DECIDED, h, s, doc, at)

    return lambda batches: _settled(batches, ("h", "s", "doc", "at"), later, single, large, crowded, decided, most)


def _fixed(column: pa.Array) -> np.ndarray:
    """Binary values of EXT bytes (nulls as zeros) as rows of bytes."""
    out = np.zeros((len(column), EXT), np.uint8)
    have = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    if len(have):
        out[have] = np.frombuffer(b"".join(column.take(pa.array(have)).to_pylist()), np.uint8).reshape(-1, EXT)
    return out


def _folded(h: np.ndarray, ext: np.ndarray) -> np.ndarray:
    """A hash of rows of EXT bytes, begun with ``h``."""
    out = h.view(np.uint64)
    for part in np.ascontiguousarray(ext).view("<u8").T:
        out = mix(out * _C[0] + part)
    return out.view(np.int64)


def _sides(data: np.ndarray, core: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The bytes that windows have beyond their core: left of it from the core outwards, right of it, and which windows there are."""
    k = np.arange(STEP - 1)
    ext = np.zeros((len(core), EXT), np.uint8)
    ext[:, : STEP - 1] = np.where(k < high[:, None], data[np.maximum(core[:, None] - 1 - k, 0)], 0)
    ext[:, STEP - 1 : 2 * STEP - 2] = np.where(k < STEP - 1 - low[:, None], data[np.minimum(core[:, None] + CORE + k, len(data) - 1)], 0)
    ext[:, -2], ext[:, -1] = low, high
    return ext


def _bare(kind, h, s, doc, at) -> pa.RecordBatch:
    """Rows in the form of pieces, without bytes."""
    n = len(h)
    none = pa.array(np.zeros(n, np.int32))
    return _rows(kind, h, s, doc, at, shard=pa.array(np.zeros(n, np.int64)), by_right=none, by_left=none, ext=pa.nulls(n, pa.binary()))


def _extract(held: int, kinds: int):
    """From texts with their needed marks: pieces of up to STEP windows that share a core of CORE bytes, with the bytes beyond it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = _Held(held)
        shard = TaskContext.get().partitionId() << 24

        def out():
            nonlocal shard
            h, s, doc, at, ext = gathered.take()
            lost, keep, crowd = _reduced(h, s, doc, at, kinds)
            x0, many, _ = _parts(at[lost])
            yield _bare(*_intervals(doc[lost], x0, x0 + many - 1 + LENGTH))
            yield _bare(*_told(h[keep[crowd]]))
            # the shard's own orders: by group and bytes to the right, and by group and bytes to the left
            h, s, doc, at, ext = (c[keep] for c in (h, s, doc, at, ext))
            wide = np.zeros((len(h), 48), np.uint8)
            wide[:, : STEP - 1], wide[:, 24 : 23 + STEP] = ext[:, : STEP - 1], ext[:, STEP - 1 : 2 * STEP - 2]
            words = wide.view(">u8").astype(np.uint64)
            left, right = [words[:, i] for i in (2, 1, 0)], [words[:, i] for i in (5, 4, 3)]
            places = []
            for side in (right, left):
                place = np.empty(len(h), np.int32)
                place[np.lexsort((*side, h))] = np.arange(len(h), dtype=np.int32)
                places.append(place)
            for i in range(0, len(h), 20_000):
                p = slice(i, i + 20_000)
                blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(EXT), len(h[p]), [None, pa.py_buffer(ext[p].tobytes())]).cast(pa.binary())
                yield _rows(crowd[p], h[p], s[p], doc[p], at[p], shard=pa.array(np.full(len(h[p]), shard)), by_right=pa.array(places[0][p]), by_left=pa.array(places[1][p]), ext=blob)
            shard += 1

        for batch in batches:
            docs = batch.column("doc").to_numpy()
            lists = batch.column("marks")
            of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            h, at = (flat.field(c).to_numpy() for c in ("h", "at"))
            for s in slices(batch.column("text")):
                here = np.flatnonzero((of >= s.rows.start) & (of < s.rows.stop))
                for block in range(0, len(here), 1 << 14):
                    some = here[block : block + (1 << 14)]
                    x0, many, offset = _parts(at[some])
                    for g in range(0, SPAN, STEP):
                        # windows with g to g + STEP - 1 bytes before the mark
                        low, high = np.maximum(offset - many + 1, g), np.minimum(offset, g + STEP - 1)
                        k = np.flatnonzero(low <= high)
                        low, high = low[k], high[k]
                        core = x0[k] + offset[k] - g
                        start = core + s.offsets[of[some[k]] - s.rows.start]
                        key = mix(hash_words(s.data, start, start + CORE) ^ (h[some[k]].view(np.uint64) + np.uint64(g)))
                        ext = _sides(s.data, start, low - g, high - g)
                        where = _at(core + g - high, high - low + 1, high - g)
                        if gathered.add(key.view(np.int64), _folded(key, ext), docs[of[some[k]]], where, ext):
                            yield from out()
        if gathered.n:
            yield from out()

    return run


def resolve(h, doc, at, shard, by_right, by_left, ext):
    """Decided intervals (doc, a, b) of pieces, all of an h together; equal windows are those whose both common prefixes reach far enough."""
    order = np.lexsort((at, doc, h))
    h, doc, at, shard, by_right, by_left, ext = (c[order] for c in (h, doc, at, shard, by_right, by_left, ext))
    n = len(h)
    x0, many, high = _parts(at)
    low = high - many + 1
    group = np.cumsum(_new(h))
    sides = []
    for place, strings in ((by_left, ext[:, : STEP - 1]), (by_right, ext[:, STEP - 1 : 2 * STEP - 2])):
        lie = np.lexsort((place, shard))  # shard after shard, each in its own order
        merged, common = merge(shard[lie], group[lie], strings[lie])
        sides.append((lie[merged], common))
    lost = np.zeros((n, STEP), bool)
    for e in range(STEP):
        rows = np.flatnonzero((low <= e) & (e <= high))
        if len(rows) < 2:
            continue
        key = classes(*sides[0], e)[rows] * (n + 1) + classes(*sides[1], STEP - 1 - e)[rows]
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        later = rows[first[back] != np.arange(len(rows))]
        lost[later, e] = True
    row, e = np.nonzero(lost)
    begin = x0[row] + high[row] - e
    return _joined(doc[row], begin, begin + LENGTH)


FOUND = "h long, w long, doc long, a long, b long"


def _resolve(held: int, chunk: int, most: int):
    """Pieces by (kind, h, s, doc, at): intervals (doc, a, b), and windows (h, w, doc, a) of crowded groups, without an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, merging = _Held(held), _Held(chunk)

        def rows(h, w, doc, a, b):
            return pa.record_batch({k: pa.array(v, pa.int64()) for k, v in zip(("h", "w", "doc", "a", "b"), (h, w, doc, a, b))})

        def found(doc, a, b):
            return rows(doc, doc, doc, a, b)

        def lose(doc, at):
            x0, many, _ = _parts(at)
            return found(*_joined(doc, x0, x0 + many - 1 + LENGTH))

        def windows():
            h, w, doc, a = gathered.take()
            order = np.lexsort((a, doc, w, h))
            first = _new(h[order], w[order])
            lost = order[~first]
            yield found(*_joined(doc[lost], a[lost], a[lost] + LENGTH))
            keep = order[first]
            for i in range(0, len(keep), 50_000):
                k = keep[i : i + 50_000]
                yield rows(h[k], w[k], doc[k], a[k], np.full(len(k), -1))

        def each_window(h, doc, at, ext):
            x0, many, high = _parts(at)
            k = np.arange(STEP - 1)
            for e in range(STEP):
                some = np.flatnonzero((high - many < e) & (e <= high))
                own = np.zeros((len(some), EXT), np.uint8)
                own[:, : STEP - 1] = np.where(k < e, ext[some, : STEP - 1], 0)
                own[:, STEP - 1 : 2 * STEP - 2] = np.where(k < STEP - 1 - e, ext[some, STEP - 1 : 2 * STEP - 2], 0)
                own[:, -1] = e
                if len(some) and gathered.add(h[some], _folded(h[some], own), doc[some], x0[some] + high[some] - e):
                    yield from windows()

        def later(h, s, doc, at, *rest):
            yield lose(doc, at)

        def large(h, s, doc, at, shard, by_right, by_left, ext):
            yield from each_window(h, doc, at, ext)

        def single(told, h, s, doc, at, shard, by_right, by_left, ext):
            some = np.isin(h, told)
            yield from each_window(h[some], doc[some], at[some], ext[some])
            some = ~some & (_of_each(_new(h), np.ones(len(h), bool)) > 1)
            if some.any() and merging.add(*(c[some] for c in (h, doc, at, shard, by_right, by_left, ext))):
                yield found(*resolve(*merging.take()))

        def crowded(first, h, s, doc, at, shard, by_right, by_left, ext):
            yield lose(doc[~first], at[~first])
            yield from each_window(h[first], doc[first], at[first], ext[first])

        def decided(h, s, doc, at):
            yield found(doc, at, s)

        columns = ("h", "s", "doc", "at", "shard", "by_right", "by_left", "ext")
        yield from _settled(batches, columns, later, single, large, crowded, decided, most)
        if merging.n:
            yield found(*resolve(*merging.take()))
        if gathered.n:
            yield from windows()

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows by (h, w, doc, a): the intervals (doc, a, b) of all but the first of each (h, w)."""
    last = None
    for batch in batches:
        h, w, doc, a = (batch.column(c).to_numpy() for c in ("h", "w", "doc", "a"))
        if not len(h):
            continue
        first = _new(h, w)
        first[0] &= last != (h[0], w[0])
        last = (h[-1], w[-1])
        doc, a, b = _joined(doc[~first], a[~first], a[~first] + LENGTH)
        yield pa.record_batch({"doc": pa.array(doc, pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _cut(as_text: bool):
    """Texts without their decided spans: as bytes, as a character may be cut in two, or as text without such halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, rest = [], [], []
            for text, parts in zip(batch.column("text"), batch.column("spans")):
                raw = (text.as_py() or "").encode()
                flat = parts.values
                _, a, b = _joined(np.zeros(len(flat), np.int64), flat.field("a").to_numpy(), flat.field("b").to_numpy())
                kept, at = [], 0
                for i, j in zip(a.tolist(), b.tolist()):
                    kept.append(raw[at:i])
                    at = j
                kept.append(raw[at:])
                removed.append(int((b - a).sum()))
                spans.append(len(a))
                rest.append(b"".join(kept).decode(errors="ignore") if as_text else b"".join(kept))
            yield pa.record_batch({
                "doc": batch.column("doc"), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
                "rest": pa.array(rest, pa.string() if as_text else pa.binary()),
            })

    return run


def _numbered(docs: DataFrame, name: str = "doc") -> tuple[DataFrame, bool]:
    """``docs`` with the column ``name``: its id where ids are unique, else a number that orders rows by id and text.

    Also whether ids are unique; if not, equal rows have the same number.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    if ids.isEmpty():
        return docs.withColumn(name, F.col("doc_id")), True
    keyed = docs.withColumn("__k", F.xxhash64(F.coalesce("text", F.lit(""))))
    order = [F.col("doc_id").asc_nulls_first(), F.col("__k")]
    parts = cut(
        keyed.select("doc_id", "__k").distinct().orderBy(*order).withColumn("part", F.spark_partition_id())
        .withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "before")
    numbers = parts.join(F.broadcast(before), "part").select(
        F.col("doc_id").alias("__i"), F.col("__k").alias("__h"), (F.col("place") + F.coalesce("before", F.lit(0))).alias(name)
    )
    met = keyed.join(cut(numbers), F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("__k") == F.col("__h")))
    return met.select(*docs.columns, name), False


def _texts(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """(doc, text) joined with a table of one row a document; few of them are picked before texts are moved."""
    ids = cut(lists.select("doc"))
    picked = docs.select("doc", "text").join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc", "left_semi")
    return picked.join(lists, "doc")


def repeated_parts(
    docs: DataFrame, as_text: bool = False, held: int = HELD, kinds: int = KINDS, chunk: int = CHUNK, few: int = FEW_KINDS, most: int = GROUP
) -> DataFrame:
    """doc, n_removed, n_spans and ``rest`` (what remains, as bytes or text) of the documents(doc, text) that lose bytes.

    ``held`` rows a task reduces at once; ``few`` and ``kinds`` from which a mark and a
    core are crowded; ``chunk`` rows are merged at once, ``most`` of one group. None
    of these changes the result.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = lambda df: df.repartition(n, F.expr(DEAL)).sortWithinPartitions("kind", "h", "s", "doc", "at")
    found = bounded(docs).select("doc", "text").mapInArrow(frugal(_mark(held, few)), ROWS)
    decided = table(deal(found).mapInArrow(frugal(_decide(most)), ROWS), "suffix-marks")
    needed = cut(decided.where(F.col("kind") == SINGLE).groupBy("doc").agg(F.collect_list(F.struct("h", "at")).alias("marks")))
    pieces = _texts(docs, needed).select("doc", "text", "marks").mapInArrow(frugal(_extract(held, kinds)), PIECES)
    resolved = table(deal(pieces).mapInArrow(frugal(_resolve(held, chunk, most)), FOUND), "suffix-pieces")
    windows = resolved.where("b < 0").repartition(n, "h", "w").sortWithinPartitions("h", "w", "doc", "a").mapInArrow(frugal(_later), "doc long, a long, b long")
    early = decided.where(F.col("kind") == DECIDED).select("doc", F.col("at").alias("a"), F.col("s").alias("b"))
    all_ = early.unionByName(resolved.where("b >= 0").select("doc", "a", "b")).unionByName(windows)
    spans = table(all_.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "suffix-spans")
    return _texts(docs, spans).select("doc", "text", "spans").mapInArrow(
        frugal(_cut(as_text)), f"doc long, n_removed long, n_spans long, rest {'string' if as_text else 'binary'}"
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; what is left of a character cut in two goes as well."""
    numbered, unique = _numbered(docs, "__doc")
    texts = numbered.select(F.col("__doc").alias("doc"), "text")
    texts = texts if unique else texts.dropDuplicates(["doc"])
    rest = table(repeated_parts(texts, as_text=True).select("doc", "rest"), "suffix-rest")
    met = numbered.join(rest.select(F.col("doc").alias("__of"), F.col("rest").alias("__rest")), F.col("__doc") == F.col("__of"), "left")
    return met.withColumn("text", F.coalesce("__rest", "text")).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs, unique = _numbered(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    parts = repeated_parts(docs if unique else docs.dropDuplicates(["doc"])).select("doc", "n_removed", "n_spans", F.sha2("rest", 256).alias("rest"))
    whole = F.coalesce("text", F.lit(""))
    all_ = docs.select("doc", "doc_id", F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole, 256).alias("whole"))
    return all_.join(parts, "doc", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("rest", "whole").alias("kept_sha256"),
    )
