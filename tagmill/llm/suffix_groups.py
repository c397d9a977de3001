"""Removal of repeated byte strings by suffix arrays built from Lyndon groups.

A byte goes if it is covered by a string of ``length`` bytes that also starts in a
document with a smaller id.

1. Every window of ``length`` bytes names its smallest GRAM-byte gram (by hash, leftmost of
   equals); windows in a row with the same one form a segment. Equal windows name equal
   grams, so the segments of one gram are a family, and no window need be compared
   outside its family. Families are dealt by hash into blocks: four hash bytes of the
   gram and a 64-bit digest of the segment each.
2. A family of one document has nothing to remove. If all of a family's segments are the
   same bytes (inside a copied passage), each window's first document is the family's
   smallest. Families with different segments (at the edges of passages) are open.
3. Windows of open families whose hash another document has too are put in one text a
   family, each distinct piece once, and its suffix array is built in linear time:
   suffixes are grouped by first byte; groups are processed from the largest down, each
   suffix finds its previous smaller one, whose Lyndon prefix grows by the group's as
   often as the group follows; then one pass from the smallest suffix up emits each
   group's order through the same pointers. Windows equal in the array share their
   smallest document. A family with one distinct piece needs no order.

Equal whole texts are one text with its smallest id, so groups of copies cost one; they
are told by 128 bits of hash. The segments of a closed family agree in 64 bits of digest
and 32 bits and the block's of the gram. Texts are moved only where a segment is shared,
and a second time only where bytes go; a bitmap, sized by their number, tells the rest.

Defined cases: null text is empty; null ids count as smaller than all others; rows of
one id never remove from each other; texts shorter than ``length`` stay whole; a very
long text is cut into pieces of CHUNK windows, without a window lost; repeated rows are a
row each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import discard, lean, release, release_executors, settle, settle_table, text_batches
from tagmill.llm.filters import split

LENGTH = 50
#: Bytes of the grams that name families: longer ones are shared by chance less often, but cut texts finer.
GRAM = 24
CHUNK = 1 << 20
BLOCK_TEXT = 24 << 20
FLUSH = 1 << 20
#: Bytes of open segments that a group of families has, about, and segments that a task packs at once.
GROUPS_TEXT = 1 << 20
PACK = 1 << 16
#: Window hashes that are compared at once.
WINDOWS = 1 << 20
#: Text hashes that may stand for several texts each.
MIXED = 1000


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of a text of positive integers, by grouping Lyndon prefixes.

    A group's members are always held in text order: previous smaller places rise with the
    place, so the lists that split off rise too. The different counts of a group are sorted;
    there are at most the square root of twice their sum of them, so time stays linear.
    """
    n = len(text)
    text = [*text, 0]  # the end is smaller than all
    members: dict[int, list[int]] = {}
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, []).append(i)
    group, ends, at = [0] * (n + 1), {}, 0
    for c in sorted(by_symbol):
        own = by_symbol[c]
        for i in own:
            group[i] = at
        members[at] = own
        ends[at + len(own)] = at
        at += len(own)
    size = {g: len(m) for g, m in members.items()}
    previous = [-1] * (n + 1)
    end = n + 1
    while end:
        g = ends[end]
        own = [i for i in members.pop(g) if group[i] == g]
        followed: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                followed[j] = followed.get(j, 0) + 1
        grown: dict[int, dict[int, list[int]]] = {}
        for j, times in followed.items():
            grown.setdefault(group[j], {}).setdefault(times, []).append(j)
        for old, by_times in grown.items():
            top = old + size[old]
            for times in sorted(by_times, reverse=True):  # more repeats of a larger prefix are larger
                moved = by_times[times]
                start = top - len(moved)
                for j in moved:
                    group[j] = start
                if start != old:
                    members[start] = moved
                else:
                    members[old] = moved
                size[start] = len(moved)
                ends[top] = start
                top = start
            if top > old:
                size[old] = top - old
                ends[top] = old
        end = g
    order, free, placed = [0] * (n + 1), {}, bytearray(n + 1)
    order[0] = n
    for i in range(n + 1):
        j = order[i] - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = group[j]
            at = free.get(g, g)
            order[at] = j
            free[g] = at + 1
            j = previous[j]
    return order[1:]


def first_documents(segments: list[tuple[bytes, int]], length: int) -> list[np.ndarray]:
    """For each window of each segment the smallest document that has the same window."""
    text: list[int] = []
    where = []
    for k, (segment, _) in enumerate(segments):
        for offset in range(len(segment)):
            where.append((k, offset) if offset + length <= len(segment) else None)
        where.append(None)
        text += [b + 2 for b in segment]
        text.append(1)
    out = [np.zeros(len(s) - length + 1, np.int64) for s, _ in segments]
    held: list[tuple[int, int]] = []
    window = None

    def close():
        least = min(segments[k][1] for k, _ in held)
        for k, offset in held:
            out[k][offset] = least

    for i in suffix_array(text):
        if (at := where[i]) is None:
            continue
        own = segments[at[0]][0][at[1] : at[1] + length]
        if own != window and held:
            close()
            held = []
        window = own
        held.append(at)
    if held:
        close()
    return out


_TABLE = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Segments:
    """Cuts texts into segments of windows with the same smallest gram."""

    def __init__(self, length: int):
        self.length = length
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            n = 1 << (n - 1).bit_length()
            for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                values = np.full(n, base, np.uint64)
                values[0] = 1
                setattr(self, name, np.cumprod(values, dtype=np.uint64))

    def of(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends (exclusive), gram hashes and digests of the segments of a text, in order."""
        parts = [self._chunk(np.frombuffer(data, np.uint8, min(len(data) - i, CHUNK + self.length - 1), i), i) for i in range(0, max(len(data) - self.length + 1, 0), CHUNK)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _chunk(self, b: np.ndarray, base: int):
        self._powers(len(b) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[b] * self.power[: len(b)], dtype=np.uint64)))
        gram = _mixed((sums[GRAM:] - sums[:-GRAM]) * self.inverse[: len(b) - GRAM + 1])
        # hash above, place below: the least is the leftmost of equal hashes
        low = (gram & ~np.uint64((1 << 21) - 1)) | np.arange(len(gram), dtype=np.uint64)
        width, span = self.length - GRAM + 1, 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            rest = width - span
            low = np.minimum(low[:-rest], low[rest:])
        place = (low & np.uint64((1 << 21) - 1)).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        end = np.append(start[1:], len(place)) + self.length - 1
        digest = _mixed((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        return start + base, end + base, gram[place[start]], digest


def _block(gram: np.ndarray, blocks: int) -> np.ndarray:
    return ((gram >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)


def _deal(length: int, blocks: int):
    """Segments of texts by block: text keys, ids, counts, gram bytes and digests."""

    def run(batches):
        cut, held, entries = Segments(length), {}, 0

        def flush():
            keys, ids = np.array(list(held), np.int64), np.array([x[0] for x in held.values()], np.int64)
            gram, digest = (np.concatenate([x[k] for x in held.values()]) for k in (1, 2))
            owner = np.repeat(np.arange(len(keys)), [len(x[1]) for x in held.values()])
            block = _block(gram, blocks)
            order = np.argsort(block, kind="stable")
            bound = np.searchsorted(block[order], np.arange(blocks + 1))
            rows = []
            for b in range(blocks):
                part = order[bound[b] : bound[b + 1]]
                if len(part):
                    own, count = np.unique(owner[part], return_counts=True)
                    rows.append((b, keys[own].tobytes(), ids[own].tobytes(), count.astype(np.uint32).tobytes(), gram[part].astype(np.uint32).tobytes(), digest[part].tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["block", "keys", "ids", "counts", "grams", "digests"])

        for batch in batches:
            for name, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if key in held:
                    held[key][0] = min(held[key][0], name)
                    continue
                data = text.as_py().encode("utf-8", "surrogatepass")
                if len(data) < length:
                    continue
                _, _, gram, digest = cut.of(data)
                held[key] = [name, gram, digest]
                entries += len(gram)
                if entries >= FLUSH:
                    yield flush()
                    held, entries = {}, 0
        if held:
            yield flush()

    return run


def _judge(homes: int):
    """For each text of a block, which of its segments go whole and which families are open, packed by the texts' homes."""

    def run(table: pa.Table) -> pa.Table:
        block, owner, marks = _marks(table)
        home = owner % homes
        rows = []
        for h in np.unique(home).tolist():
            names, count = np.unique(owner[home == h], return_counts=True)
            rows.append((h, block, names.tobytes(), count.astype(np.uint32).tobytes(), marks[home == h].tobytes()))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        return pa.table({"home": pa.array(cols[0], pa.int32()), "block": pa.array(cols[1], pa.int32()), **{n: pa.array(c, pa.binary()) for n, c in zip(("keys", "counts", "marks"), cols[2:], strict=True)}})

    return run


def _by_text(table: pa.Table) -> pa.Table:
    """One row a text: its blocks, the number of marks in each and the marks."""
    get = lambda name, kind: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    keys, counts, marks = get("keys", np.int64), get("counts", np.uint32), np.concatenate(get("marks", np.uint32))
    block = np.repeat(np.array(table.column("block").to_pylist(), np.int32), [len(k) for k in keys])
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    starts = (np.cumsum(counts, dtype=np.int64) - counts)[order]
    keys, counts, block = keys[order], counts[order], block[order]
    take = np.repeat(starts - (np.cumsum(counts, dtype=np.int64) - counts), counts) + np.arange(counts.sum(dtype=np.int64))
    marks = marks[take]
    cut = np.flatnonzero(np.concatenate(([True], np.diff(keys) != 0, [True])))
    ends = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    rows = [(block[a:b].tobytes(), counts[a:b].tobytes(), marks[ends[a] : ends[b]].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    cols = list(zip(*rows, strict=True)) or [()] * 3
    return pa.table({"key": pa.array(keys[cut[:-1]]), **{n: pa.array(c, pa.binary()) for n, c in zip(("blocks", "counts", "marks"), cols, strict=True)}})


def _marks(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    """The block's number, and sorted by text: its key and twice a segment's place among the text's own, odd if its family is open."""
    get = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])
    block = table.column("block")[0].as_py()
    keys, ids, counts, grams, digests = get("keys", np.int64), get("ids", np.int64), get("counts", np.uint32), get("grams", np.uint32), get("digests", np.uint64)
    # copies of a text came more than once: keep one, with the smallest id
    names, at = np.unique(keys, return_inverse=True)
    least = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(least, at, ids)
    starts = np.cumsum(counts, dtype=np.int64) - counts
    first = np.full(len(names), len(keys))
    np.minimum.at(first, at, np.arange(len(keys)))
    take = np.repeat(np.arange(len(keys)) == first[at], counts)
    owner = np.repeat(at.astype(np.int32), counts)[take]
    ordinal = (np.arange(len(grams), dtype=np.int64) - np.repeat(starts, counts))[take].astype(np.uint32)
    grams, digests = grams[take], digests[take]
    order = np.argsort(grams, kind="stable")
    gram, own, digest, ordinal = grams[order], owner[order], digests[order], ordinal[order]
    del take, grams, digests, owner, order
    cut = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
    size = np.diff(np.append(cut, len(gram)))
    several = np.maximum.reduceat(own, cut) != np.minimum.reduceat(own, cut)
    same = np.maximum.reduceat(digest, cut) == np.minimum.reduceat(digest, cut)
    smallest = np.minimum.reduceat(least[own], cut)
    spread = lambda x: np.repeat(x, size)
    gone = spread(several & same) & (spread(smallest) < least[own])
    still_open = spread(several & ~same)
    picked = np.flatnonzero(gone | still_open)
    place = ordinal[picked]
    sort = np.lexsort((place, own[picked]))
    picked = picked[sort]
    return block, names[own[picked]], (place[sort] * 2 + still_open[picked]).astype(np.uint32)


def _merged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spans in order of their starts, those that touch as one."""
    if not len(start):
        return np.zeros((0, 2), np.int64)
    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
    return np.stack([start[first], reach[np.append(first[1:] - 1, len(start) - 1)]], axis=1).astype(np.int64)


#: Columns of distinct segments (with the number of places of each), and of their places.
DISTINCT = {"families": np.uint64, "digests": np.uint64, "sizes": np.int32, "counts": np.int32}
PLACES = {"keys": np.int64, "ids": np.int64, "starts": np.int64}
FOUND = ", ".join(["group int", *(f"{c} binary" for c in (*DISTINCT, *PLACES, "segments")), "key long", "spans binary"])


def _extract(length: int, blocks: int, groups: int):
    """Spans of segments that go (with ``key``), and the segments of open families, packed by group of families."""
    types = [pa.int32(), *[pa.binary()] * 8, pa.int64(), pa.binary()]
    names = ["group", *DISTINCT, *PLACES, "segments", "key", "spans"]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def pack(held):
        family, digest, keys, ids, starts, sizes = (np.concatenate(x) for x in list(zip(*held, strict=True))[:6])
        data = np.frombuffer(b"".join(x[6] for x in held), np.uint8)
        at = np.cumsum(sizes, dtype=np.int64) - sizes
        group = (family % np.uint64(groups)).astype(np.int32)
        order = np.lexsort((digest, family, group))
        family, digest, keys, ids, starts, sizes, group, at = (x[order] for x in (family, digest, keys, ids, starts, sizes, group, at))
        # equal segments go once, with all their places
        new = np.flatnonzero(np.concatenate(([True], (family[1:] != family[:-1]) | (digest[1:] != digest[:-1]))))
        count = np.diff(np.append(new, len(family))).astype(np.int32)
        family, digest, sizes, group, at = (x[new] for x in (family, digest, sizes, group, at))
        data, edge = _gathered(data, at, sizes)
        places = np.append(new, len(keys))
        cut = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))).tolist()
        rows = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            own = slice(places[a], places[b])
            rows.append((int(group[a]), *(x[a:b].tobytes() for x in (family, digest, sizes, count)), *(x[own].tobytes() for x in (keys, ids, starts)), data[edge[a] : edge[b]].tobytes(), None, None))
        return batch_of(rows)

    def run(batches):
        cut, held, count = Segments(length), [], 0
        for batch in batches:
            gone = []
            for row in batch.to_pylist():
                data = row["text"].encode("utf-8", "surrogatepass")
                start, end, gram, digest = cut.of(data)
                block, marks = _block(gram, blocks), np.frombuffer(row["marks"], np.uint32)
                closed, opened, at = [], [], 0
                order = np.argsort(block, kind="stable")  # the text's segments by block, in order
                bound = np.searchsorted(block[order], np.arange(blocks + 1))
                for told, n in zip(np.frombuffer(row["blocks"], np.int32).tolist(), np.frombuffer(row["counts"], np.uint32).tolist(), strict=True):
                    own, mark = order[bound[told] : bound[told + 1]], marks[at : at + n]
                    at += n
                    closed.append(own[mark[mark % 2 == 0] // 2])
                    opened.append(own[mark[mark % 2 == 1] // 2])
                closed, opened = np.sort(np.concatenate(closed)), np.concatenate(opened)
                if len(closed):
                    gone.append((int(gram[closed[0]] % np.uint64(groups)), *[None] * 8, row["key"], _merged(start[closed], end[closed]).tobytes()))
                if len(opened):
                    size = (end - start)[opened].astype(np.int32)
                    pieces = b"".join([data[a:b] for a, b in zip(start[opened].tolist(), end[opened].tolist(), strict=True)])
                    held.append((gram[opened], digest[opened], np.full(len(opened), row["key"]), np.full(len(opened), row["id"]), start[opened].astype(np.int64), size, pieces))
                    count += len(opened)
                    if count >= PACK:
                        yield pack(held)
                        held, count = [], 0
            if gone:
                yield batch_of(gone)
        if held:
            yield pack(held)

    return run


def _gathered(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of ``data`` one after the other, and the edges between them."""
    edge = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    return data[np.repeat(at - edge[:-1], sizes) + np.arange(edge[-1])], edge


def _repeated_windows(cut: Segments, data: np.ndarray, at: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of segments may be in several documents (by hash, so none is missed), and each segment's first window.

    ``low`` and ``high`` are a segment's first and last documents. Hashes are compared in as
    many parts as keep a part near WINDOWS of them, so memory stays bounded.
    """
    count = (sizes - length + 1).astype(np.int64)
    base = np.cumsum(count) - count
    total = int(count.sum())
    parts, mask = max(1, total // WINDOWS), np.zeros(total, bool)
    steps = np.searchsorted(base, np.arange(0, total, WINDOWS))
    steps = np.unique(np.append(steps, len(sizes)))
    for part in range(parts):
        codes, windows, owners = [], [], []
        for a, b in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
            text, edge = _gathered(data, at[a:b], sizes[a:b])
            cut._powers(len(text) + 1)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[text] * cut.power[: len(text)], dtype=np.uint64)))
            first = np.repeat(edge[:-1] - (base[a:b] - base[a]), count[a:b]) + np.arange(count[a:b].sum())
            code = _mixed((sums[first + length] - sums[first]) * cut.inverse[first])
            own = np.flatnonzero((code >> np.uint64(20)) % np.uint64(parts) == part)
            codes.append(code[own])
            windows.append(own + base[a])
            owners.append(np.repeat(np.arange(a, b, dtype=np.int32), count[a:b])[own])
        code, window, owner = np.concatenate(codes), np.concatenate(windows), np.concatenate(owners)
        if len(code):
            order = np.argsort(code, kind="stable")
            start = np.flatnonzero(np.concatenate(([True], np.diff(code[order]) != 0)))
            several = np.minimum.reduceat(low[owner[order]], start) != np.maximum.reduceat(high[owner[order]], start)
            mask[window[order]] = np.repeat(several, np.diff(np.append(start, len(code))))
    return mask, base


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _compare(length: int):
    """Spans that go in open families, and the spans that are known already; a group has whole families."""

    def run(table: pa.Table) -> pa.Table:
        known = table.filter(pc.is_valid(table.column("key")))
        out = [(known.column("key").to_pylist(), known.column("spans").to_pylist())]
        packed = table.filter(pc.is_valid(table.column("families")))
        if packed.num_rows:
            out.append(_compare_packed(packed, length))
        keys, spans = (sum((list(x[i]) for x in out), []) for i in (0, 1))
        return pa.table({"key": pa.array(keys, pa.int64()), "spans": pa.array(spans, pa.binary())})

    return run


def _compare_packed(table: pa.Table, length: int) -> tuple[list[int], list[bytes]]:
    """Keys of texts and their spans."""
    get = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])
    family, digest, sizes, counts = (get(n, k) for n, k in DISTINCT.items())
    keys, ids, starts = (get(n, k) for n, k in PLACES.items())
    data = get("segments", np.uint8)
    # equal segments of several tasks are one
    order = np.lexsort((digest, family))
    new = np.concatenate(([True], (family[order][1:] != family[order][:-1]) | (digest[order][1:] != digest[order][:-1])))
    which = np.empty(len(order), np.int32)
    which[order] = np.cumsum(new) - 1
    at = (np.cumsum(sizes, dtype=np.int64) - sizes)[order[new]]
    family, sizes = family[order[new]], sizes[order[new]]
    owner = np.repeat(which, counts)
    order = np.argsort(owner, kind="stable")
    keys, ids, starts = keys[order], ids[order], starts[order]
    places = np.searchsorted(owner[order], np.arange(len(sizes) + 1))
    low, high = np.minimum.reduceat(ids, places[:-1]), np.maximum.reduceat(ids, places[:-1])
    del digest, order, owner, which, new
    mask, base = _repeated_windows(Segments(length), data, at, sizes, low, high, length)
    # runs of windows that may be repeated, none of two segments
    edge = np.zeros(len(mask) + 1, bool)
    edge[base] = edge[-1] = True
    begin = np.flatnonzero(mask & (edge[:-1] | np.concatenate(([True], ~mask[:-1]))))
    end = np.flatnonzero(mask & (edge[1:] | np.concatenate((~mask[1:], [True])))) + 1
    segment = np.searchsorted(base, begin, "right") - 1
    offset = begin - base[segment]
    text, first_byte = data.tobytes(), at[segment] + offset
    del edge, mask, data
    # what may be repeated is compared by the suffix array of its family, each distinct piece once with its smallest document
    pieces: dict[int, dict[bytes, list[int]]] = {}
    for r, (f, a, n) in enumerate(zip(family[segment].tolist(), first_byte.tolist(), (end - begin).tolist(), strict=True)):
        pieces.setdefault(f, {}).setdefault(text[a : a + n + length - 1], []).append(r)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # text keys, starts and ends of spans
    for own in pieces.values():
        least = [int(low[segment[r]].min()) for r in own.values()]
        if len(own) > 1:
            firsts = first_documents(list(zip(own, least, strict=True)), length)
        else:
            firsts = [np.full(len(p) - length + 1, x) for p, x in zip(own, least, strict=True)]
        for rows, first in zip(own.values(), firsts, strict=True):
            lowest, highest = first.min(), first.max()
            for r in rows:
                u = segment[r]
                if lowest >= high[u]:
                    continue
                own_ids = ids[places[u] : places[u + 1]]
                own_keys, own_starts = keys[places[u] : places[u + 1]], starts[places[u] : places[u + 1]] + offset[r]
                whole = own_ids > highest
                found.append((own_keys[whole], own_starts[whole], own_starts[whole] + len(first) + length - 1))
                for i in np.flatnonzero(~whole & (own_ids > lowest)).tolist():
                    for a, b in _runs(first < own_ids[i]):
                        found.append((own_keys[i : i + 1], own_starts[i : i + 1] + a, own_starts[i : i + 1] + b + length - 1))
    if not found:
        return [], []
    key, start, stop = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((start, key))
    key, start, stop = key[order], start[order], stop[order]
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))).tolist() if len(key) else [0]
    return key[cut[:-1]].tolist(), [_merged(start[a:b], stop[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _cut(batches):
    """Lengths, removed bytes, runs and digest of what is left."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            data = row["text"].encode("utf-8", "surrogatepass")
            edge = np.zeros(len(data) + 1, np.int64)
            if row["whole"]:
                edge[0], edge[-1] = 1, -1
            for raw in row["spans"] or ():
                span = np.frombuffer(raw, np.int64).reshape(-1, 2)
                np.add.at(edge, span[:, 0], 1)
                np.add.at(edge, span[:, 1], -1)
            mask = np.cumsum(edge[:-1]) > 0
            runs = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if len(mask) else 0
            kept = np.frombuffer(data, np.uint8)[~mask].tobytes()
            rows.append((row["doc_id"], len(data), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _keyed(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, id (never null), key of the text and text of each row; and the least id and number of rows of each text.

    Equal keys mean equal texts: 64 bits of hash, checked by 64 others. Texts that only the
    others tell apart (one pair in 10**10 texts, about) get keys from both.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    null_id = -(1 << 63)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(key).cast("long"), F.lit(null_id)).alias("id"), F.xxhash64(body).alias("key"), body.alias("text"))
    other = F.xxhash64(F.lit("other"), "text")
    texts = settle(rows.select("id", "key", other.alias("o"), F.octet_length("text").alias("n_bytes")).groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.max("n_bytes").alias("n_bytes"), F.min("o").alias("o"), F.max("o").alias("p")))
    mixed = [r["key"] for r in texts.where("o <> p").select("key").limit(MIXED + 1).collect()]
    if mixed:
        if len(mixed) > MIXED:
            raise ValueError(f"over {MIXED} text hashes stand for several texts")
        rows = rows.withColumn("key", F.when(F.col("key").isin(mixed), F.xxhash64("key", other)).otherwise(F.col("key")))
        texts = settle(rows.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.max(F.octet_length("text")).alias("n_bytes")))
    return rows, texts.select("key", "least", "n", "n_bytes")


def remove(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, block_text: int = BLOCK_TEXT, kept_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and with ``kept_bytes`` the bytes left) of every row."""
    spark = docs.sparkSession
    text_batches(spark)
    release_executors(spark)
    rows, texts = _keyed(docs, key, text)
    total = texts.agg(F.sum(F.col("n") * F.col("n_bytes"))).first()[0] or 0
    blocks, groups = max(1, total // block_text), max(1, total // (2 * GROUPS_TEXT))
    dealt = rows.select("id", "key", "text").mapInArrow(lean(_deal(length, blocks)), "block int, keys binary, ids binary, counts binary, grams binary, digests binary")
    told = dealt.groupBy("block").applyInArrow(lean(_judge(blocks)), "home int, block int, keys binary, counts binary, marks binary")
    told = settle_table(told.groupBy("home").applyInArrow(lean(_by_text), "key long, blocks binary, counts binary, marks binary"))
    del dealt
    release(spark)
    release_executors(spark)
    # one row a text: its smallest document
    shared, _ = split(rows, "key", told.select("key"))
    firsts = shared.join(told.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).join(texts.select(F.col("key").alias("k2"), "least"), F.col("key") == F.col("k2")).where("id = least")
    found = firsts.select("key", "id", "text", "blocks", "counts", "marks").mapInArrow(lean(_extract(length, blocks, groups)), FOUND)
    spans = found.groupBy("group").applyInArrow(lean(_compare(length)), "key long, spans binary")
    spans = spans.groupBy("key").agg(F.collect_list("spans").alias("spans"))
    # texts move again where bytes go; copies of a text go whole
    special = texts.join(spans, "key", "left").where(F.col("spans").isNotNull() | (F.col("n") > 1) & (F.col("n_bytes") >= length))
    special = settle_table(special.select(F.col("key").alias("k"), "least", "spans"))
    del shared, firsts, found, spans
    discard(spark, told)
    release(spark)
    release_executors(spark)
    moved, rest = split(rows, "key", special.select("k"))
    is_copy = (F.col("id") > F.col("least")) & (F.octet_length("text") >= length)
    joined = moved.join(special, F.col("key") == F.col("k"), "left")
    done = joined.select("doc_id", "text", F.coalesce(is_copy, F.lit(False)).alias("whole"), F.when(F.col("id") == F.col("least"), F.col("spans")).alias("spans"))
    cut = done.mapInArrow(lean(_cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    rest = rest.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.encode("text", "UTF-8").alias("kept"))
    out = cut.unionByName(rest)
    return out if kept_bytes else out.drop("kept")
