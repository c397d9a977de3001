"""N-gram Jaccard join by signature trees.

Sets are the 64-bit hashes of a text's distinct word 5-grams. Equal sets are one node.

1. Isolation. Two nodes of Jaccard similarity t share at least t of either's n-grams, so
   a node with more than (1 - t) n of them known to be its own links with nothing. Half
   of all n-grams, chosen by hash, are dealt by hash into blocks; a block tells which of
   them two nodes have. Hash collisions only keep a node that could have gone. Texts are
   cut into n-grams once for this, and once more if the node is left.
2. Prefixes. Of the nodes left, any linked pair shares an n-gram of both prefixes: the
   first n - ceil(t n) + 1 under one order, the rarest first. Blocks of n-grams count
   exactly in how many nodes each one is and send the counts home, where the prefix is
   taken; n-grams of one node only come first and are never sent. So passages of many
   documents seldom stand in a prefix. N-grams are told apart by block and four bytes
   here; one that two n-grams share joins more candidates and loses none.
3. Candidates. Nodes of a prefix n-gram are chained by size as far as sizes allow a link;
   components of the chains are the clusters.
4. Trees. In a cluster, nodes lie in leaves of similar sets under a hierarchy of nodes
   with OR- and AND-combined bitmaps and size ranges. Two tree nodes are traversed
   together and dropped if their sizes are too far apart or the overlap they may have at
   most (size less the bits that all of one side have and none of the other) is too small.
   Pairs that reach the leaves are compared exactly, unless already connected.
5. Clusters over ``limit`` n-grams are solved in rounds of a linear number of comparisons:
   nodes with the same least n-gram under a hash are a tree (cut at random if too large),
   later rounds use one node of each component found and least n-gram under another hash.
   What is open then are prefix n-grams whose nodes are in several components: their nodes
   are clustered anew, and a cluster that is still too large is cut into bands of size and
   blocks, each pair of blocks that can hold a link being a task of its own.

The links found span each component, so components need no other pair. Shuffled: four
bytes for half of the n-grams, then counts, prefixes and sets of the nodes that are left.

Defined cases: null, empty and wordless texts have an empty set and are their own
component; a text of fewer words than n is one n-gram; a very long text is one row of
n-grams like any other (eight bytes each, in one task's memory); null ids never name a
component (it is null if there is no other id); repeated rows give a row each; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.graph import components
from tagmill.llm.common import arrow_rows, discard, lean, release, settle, settle_table
from tagmill.llm.filters import LEAST_BITS, MOST_BITS, bitmap

N = 5
PERCENT = 80
#: Text bytes whose n-grams make a block of the isolation step.
BLOCK_TEXT = 24 << 20
#: N-grams that a task of the tree step holds of either side.
LIMIT = 4 << 20
#: N-grams that a block of the counting step holds.
COUNT_BLOCK = 1 << 20
#: Hashes under which nodes of too large clusters are brought together.
ROUNDS = 3
LEAF, FAN = 16, 8


def _band(percent: int) -> float:
    """Ratio of sizes across a band: just over that of any linked pair."""
    return 100 / percent * 1.001
FLUSH = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 1 << 18:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def shingles(text: str | None, cache: WordHashes, n: int) -> np.ndarray:
    """Sorted hashes of the distinct word n-grams of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    size = min(n, len(w))
    out = np.full(len(w) - size + 1, size, np.uint64)
    for j in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + w[j : j + len(out)]
    return np.unique(mixed(out))


def slack(n: int, percent: int) -> int:
    """N-grams of a set of ``n`` that a linked one may lack."""
    return n - -(-percent * n // 100)


def linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def _sampled(tokens: np.ndarray) -> np.ndarray:
    return tokens[(tokens & np.uint64(1)) == 0]


def _node(tokens: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _deal(n: int, blocks: int):
    """Blocks of sampled n-grams: nodes, count of each and four hash bytes an n-gram; and, with ``ids``, what the rows are."""

    def run(batches):
        cache, held, entries, at = WordHashes(), {}, 0, 0

        def flush():
            nodes = np.array(list(held), np.int64)
            sizes = np.array([len(t) for t in held.values()], np.int64)
            tokens = np.concatenate(list(held.values())) if held else np.zeros(0, np.uint64)
            return _packed_deal(nodes, sizes, tokens >> np.uint64(1), blocks)

        for batch in batches:
            told = []
            for text in batch.column(1):
                tokens = shingles(text.as_py(), cache, n)
                name = _node(tokens) if len(tokens) else 0
                own = _sampled(tokens)
                told.append((name, len(tokens), len(own)))
                if len(tokens) and name not in held:
                    held[name] = own
                    entries += len(own)
                    if entries >= FLUSH:
                        yield flush()
                        held, entries = {}, 0
            if told:
                name, size, sampled = (np.array(x, np.int64) for x in zip(*told, strict=True))
                ids = batch.column(0)
                row = (at % blocks, name.tobytes(), size.tobytes(), sampled.tobytes(), ids.fill_null(0).to_numpy().tobytes(), ids.is_valid().to_numpy(zero_copy_only=False).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), *[pa.binary()] * 5), strict=True)], DEALT)
                at += 1
        if held:
            yield flush()

    return run


DEALT = ["block", "nodes", "counts", "tokens", "ids", "known"]
DEALT_SCHEMA = "block int, nodes binary, counts binary, tokens binary, ids binary, known binary"


def _packed_deal(nodes: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, blocks: int) -> pa.RecordBatch:
    """A row a block: its nodes, how many n-grams each has there, and their low four bytes."""
    owner = np.repeat(np.arange(len(nodes), dtype=np.int32), sizes)
    block = ((tokens >> np.uint64(32)) % np.uint64(blocks)).astype(np.int32)
    order = np.argsort(block, kind="stable")
    cut = np.searchsorted(block[order], np.arange(blocks + 1))
    owner, brief, rows = owner[order], tokens.astype(np.uint32)[order], []
    for b in range(blocks):
        part = slice(cut[b], cut[b + 1])
        if cut[b] < cut[b + 1]:
            own = owner[part]  # in order of the nodes
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            count = np.diff(np.append(first, len(own)))
            rows.append((b, nodes[own[first]].tobytes(), count.astype(np.uint32).tobytes(), brief[part].tobytes(), None, None))
    cols = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], DEALT)


def _unpack_told(batches):
    """doc_id, n, sampled and node of every row."""
    for batch in batches:
        for row in batch.to_pylist():
            name, size, sampled, ids = (np.frombuffer(row[c], np.int64) for c in ("nodes", "counts", "tokens", "ids"))
            none = np.frombuffer(row["known"], np.uint8) == 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=none), pa.array(size), pa.array(sampled), pa.array(name, mask=size == 0)], ["doc_id", "n", "sampled", "node"])


def _shared(blocks: int):
    """Nodes of a block and how many of their n-grams another node has too, packed by the nodes' own blocks; rows with ``ids`` pass."""

    def run(table: pa.Table) -> pa.Table:
        told = table.filter(pc.is_valid(table.column("ids")))
        names, found = _count_shared(table.filter(pc.is_null(table.column("ids"))))
        block = names % blocks
        rows = [(int(b), names[block == b].tobytes(), found[block == b].astype(np.uint32).tobytes(), None, None, None) for b in np.unique(block)]
        cols = list(zip(*rows, strict=True)) or [()] * 6
        out = pa.table({n: pa.array(c, pa.int32() if n == "block" else pa.binary()) for n, c in zip(DEALT, cols, strict=True)})
        return pa.concat_tables([out, told.select(DEALT).cast(out.schema)])

    return run


def _sum_shared(table: pa.Table) -> pa.Table:
    nodes = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("nodes").to_pylist()])
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()])
    names, at = np.unique(nodes, return_inverse=True)
    return pa.table({"node": pa.array(names), "shared": pa.array(np.bincount(at, counts, len(names)).astype(np.int64))})


def _count_shared(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    if not table.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = {c: table.column(c).to_pylist() for c in ("nodes", "counts", "tokens")}
    nodes = np.concatenate([np.frombuffer(x, np.int64) for x in parts["nodes"]])
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in parts["counts"]])
    tokens = np.concatenate([np.frombuffer(x, np.uint32) for x in parts["tokens"]])
    names, at = np.unique(nodes, return_inverse=True)
    owner, found = np.repeat(at.astype(np.uint32), counts), np.zeros(len(names), np.int64)
    for part in range(8):  # an eighth of the hashes at a time bounds what is sorted at once
        own = tokens >> np.uint32(29) == part
        pairs = np.unique(tokens[own].astype(np.uint64) << np.uint64(32) | owner[own])
        token = pairs >> np.uint64(32)
        same = np.flatnonzero(token[1:] == token[:-1])
        hit = np.zeros(len(pairs), bool)
        hit[same] = hit[same + 1] = True
        found += np.bincount((pairs[hit] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=len(names))
    keep = found > 0
    return names[keep], found[keep]


def _sets(n: int, shared):
    """Node, size and set of the documents that the bitmap lets through."""

    def run(batches):
        cache, bitmap = WordHashes(), shared.value
        for batch in batches:
            at = batch.column(1).to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            rows = []
            for i in keep.tolist():
                tokens = shingles(batch.column(2)[i].as_py(), cache, n)
                if len(tokens):
                    rows.append((_node(tokens), len(tokens), tokens.tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["node", "n", "tokens"])

    return run


def _deal_sets(blocks: int):
    """N-grams of a batch of sets, dealt into blocks, with the sets' sizes in ``ids``."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                nodes, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                dealt = _packed_deal(nodes, size, np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64), blocks)
                of = dict(zip(nodes.tolist(), size.tolist(), strict=True))
                sizes = [np.array([of[x] for x in np.frombuffer(raw, np.int64).tolist()], np.uint32).tobytes() for raw in dealt.column("nodes").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(dealt.column(c) for c in DEALT[:4]), pa.array(sizes, pa.binary())], ["block", "nodes", "counts", "tokens", "sizes"])

    return run


def _joined(table: pa.Table, **kinds) -> list[np.ndarray]:
    """Packed columns, unpacked and concatenated over the rows."""
    return [np.concatenate([np.frombuffer(x, k) for x in table.column(c).to_pylist()]) for c, k in kinds.items()]


def _count(homes: int):
    """For each node of a block: how many n-grams only it has, and the others with their number of nodes, packed by home."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        nodes, sizes, counts, tokens = _joined(table, nodes=np.int64, sizes=np.uint32, counts=np.uint32, tokens=np.uint32)
        names, first, at = np.unique(nodes, return_index=True, return_inverse=True)
        pairs = np.unique(tokens.astype(np.uint64) << np.uint64(32) | np.repeat(at.astype(np.uint64), counts))
        del tokens, counts
        token, owner = (pairs >> np.uint64(32)).astype(np.uint32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int32)
        del pairs
        cut = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
        among = np.repeat(np.diff(cut), np.diff(cut)).astype(np.uint32)
        alone = np.bincount(owner[among == 1], minlength=len(names)).astype(np.uint32)
        keep = among > 1
        token, owner, among = token[keep], owner[keep], among[keep]
        order = np.lexsort((owner, (names % homes)[owner]))
        token, owner, among = token[order], owner[order], among[order]
        shared = np.bincount(owner, minlength=len(names)).astype(np.uint32)
        home, rows = names % homes, []
        bound = np.searchsorted(home[owner], np.arange(homes + 1))
        for h in np.unique(home).tolist():
            own, part = home == h, slice(bound[h], bound[h + 1])
            rows.append((h, block, names[own].tobytes(), sizes[first][own].tobytes(), alone[own].tobytes(), shared[own].tobytes(), token[part].tobytes(), among[part].tobytes()))
        cols = list(zip(*rows, strict=True))
        return pa.table({"home": pa.array(cols[0], pa.int32()), "block": pa.array(cols[1], pa.int32()), **{n: pa.array(c, pa.binary()) for n, c in zip(("nodes", "sizes", "alone", "counts", "tokens", "among"), cols[2:], strict=True)}})

    return run


COUNTED = "home int, block int, nodes binary, sizes binary, alone binary, counts binary, tokens binary, among binary"


def _prefixes(percent: int, blocks: int):
    """Prefix n-grams (of two nodes or more) of the nodes of a home, packed by block again."""

    def run(table: pa.Table) -> pa.Table:
        nodes, sizes, alone, counts, tokens, among = _joined(table, nodes=np.int64, sizes=np.uint32, alone=np.uint32, counts=np.uint32, tokens=np.uint32, among=np.uint32)
        per_row = [len(x) // 4 for x in table.column("tokens").to_pylist()]
        block = np.repeat(table.column("block").to_numpy().astype(np.int32), per_row)
        names, first, at = np.unique(nodes, return_index=True, return_inverse=True)
        size = sizes[first].astype(np.int64)
        room = size - -(-percent * size // 100) + 1 - np.bincount(at, alone, len(names)).astype(np.int64)
        owner = np.repeat(at.astype(np.int32), counts)
        order = np.lexsort((block, tokens, among, owner))
        owner, tokens, block = owner[order], tokens[order], block[order]
        starts = np.searchsorted(owner, np.arange(len(names)))
        keep = np.arange(len(owner)) - starts[owner] < room[owner]
        owner, tokens, block = owner[keep], tokens[keep], block[keep]
        order, rows = np.argsort(block, kind="stable"), []
        cut = np.searchsorted(block[order], np.arange(blocks + 1))
        for b in range(blocks):
            part = order[cut[b] : cut[b + 1]]
            if len(part):
                rows.append((b, tokens[part].tobytes(), names[owner[part]].tobytes(), size[owner[part]].astype(np.uint32).tobytes()))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table({"block": pa.array(cols[0], pa.int32()), **{n: pa.array(c, pa.binary()) for n, c in zip(("tokens", "nodes", "sizes"), cols[1:], strict=True)}})

    return run


def _meet(percent: int):
    """Chains over the nodes of each prefix n-gram of a block, by size."""

    def run(table: pa.Table) -> pa.Table:
        token, node, size = _joined(table, tokens=np.uint32, nodes=np.int64, sizes=np.uint32)
        order = np.lexsort((node, size, token))
        token, node, size = token[order], node[order], size[order].astype(np.int64)
        near = (token[1:] == token[:-1]) & (100 * size[:-1] >= percent * size[1:])
        edges = np.unique(np.stack([node[:-1][near], node[1:][near]]), axis=1)
        return pa.table({"src": pa.array(edges[0]), "dst": pa.array(edges[1])})

    return run


def _unpack_prefixes(batches):
    """token (block and four bytes), node."""
    for batch in batches:
        for row in batch.to_pylist():
            token = np.frombuffer(row["tokens"], np.uint32).astype(np.int64) | np.int64(row["block"]) << 32
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.frombuffer(row["nodes"], np.int64))], ["token", "node"])


def _marks(batches):
    """Node, size and its least n-grams under ROUNDS hashes."""
    for batch in batches:
        rows = []
        for name, size, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            own = np.frombuffer(raw, np.uint64)
            rows.append((name, size, [int(mixed(own ^ np.uint64(0x9E3779B97F4A7C15 * (r + 1) & (1 << 64) - 1)).min().view(np.int64)) for r in range(ROUNDS)]))
        cols = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64()))], ["node", "n", "marks"])


class Tree:
    """Signature tree over sets: levels of OR and AND bitmaps and size ranges, leaves first."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.size = np.array([len(s) for s in sets])
        bits = 1 << min(14, max(9, int(2 * np.median(self.size)).bit_length()))
        self.bits = np.zeros((len(sets), bits // 64), np.uint64)
        for i, s in enumerate(sets):
            at = (s >> np.uint64(20)) & np.uint64(bits - 1)
            np.bitwise_or.at(self.bits[i], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        self.levels = []
        some, every, low, high, width = self.bits, self.bits, self.size, self.size, LEAF
        span = 1
        while True:
            cut = np.arange(0, len(low), width)
            some, every = np.bitwise_or.reduceat(some, cut), np.bitwise_and.reduceat(every, cut)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            span *= width
            self.levels.append((some, every, low, high, span))
            if len(low) == 1:
                return
            width = FAN

    def apart(self, level: int, i: int, j: np.ndarray, percent: int) -> np.ndarray:
        """Which tree nodes ``j`` can hold no set linked with one of node ``i``."""
        some, every, low, high, _ = self.levels[level]
        far = (100 * np.minimum(high[i], high[j]) < percent * np.maximum(low[i], low[j]))
        most_i = high[i] - np.bitwise_count(every[i] & ~some[j]).sum(axis=1, dtype=np.int64)
        most_j = high[j] - np.bitwise_count(every[j] & ~some[i]).sum(axis=1, dtype=np.int64)
        return far | ((100 + percent) * np.minimum(most_i, most_j) < percent * (low[i] + low[j]))

    def links(self, percent: int, side: np.ndarray | None = None, label: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links that span the components; with ``side`` only links between its two values. Sets of one ``label`` are connected already."""
        n, out, root = len(self.sets), [], np.arange(len(self.sets))
        if label is not None:
            _, root = np.unique(label, return_inverse=True)
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            span = self.levels[level][4]
            x, y = slice(i * span, min(n, (i + 1) * span)), slice(j * span, min(n, (j + 1) * span))
            first = root[x.start]
            if (root[x] == first).all() and (root[y] == first).all():
                continue  # one component already
            if level:
                per = span // self.levels[level - 1][4]
                count = len(self.levels[level - 1][2])
                for a in range(i * per, min(count, (i + 1) * per)):
                    b = np.arange(max(a, j * per), min(count, (j + 1) * per))
                    if len(b):
                        stack += [(level - 1, a, int(c)) for c in b[~self.apart(level - 1, a, b, percent)]]
                continue
            a, b = self.bits[x], self.bits[y]
            sa, sb = self.size[x], self.size[y]
            most = np.minimum(sa[:, None] - np.bitwise_count(a[:, None] & ~b[None]).sum(axis=2, dtype=np.int64), sb[None] - np.bitwise_count(b[None] & ~a[:, None]).sum(axis=2, dtype=np.int64))
            may = (100 + percent) * most >= percent * (sa[:, None] + sb[None])
            for p, q in np.argwhere(may):
                p, q = p + x.start, q + y.start
                if q <= p and i == j or root[p] == root[q] or side is not None and side[p] == side[q]:
                    continue
                common = np.intersect1d(self.sets[p], self.sets[q], assume_unique=True).size
                if linked(common, self.size[p], self.size[q], percent):
                    out.append((int(p), int(q)))
                    root[root == root[q]] = root[p]
        return out


def _join_group(percent: int):
    """Links of every cluster (or pair of blocks of one) in a group."""

    def run(table: pa.Table) -> pa.Table:
        unit = table.column("unit").to_numpy()
        node, side, label = (table.column(c).to_numpy() for c in ("node", "side", "label"))
        tokens = table.column("tokens").to_pylist()
        sets = [np.frombuffer(t, np.uint64) for t in tokens]
        least = np.array([s[0] for s in sets], np.uint64)
        order = np.lexsort((node, [len(s) for s in sets], least, unit))
        # a node may have come twice: repeated rows, or copies that the bitmap let through
        order = order[np.concatenate(([True], (np.diff(unit[order]) != 0) | (np.diff(node[order]) != 0)))] if len(order) else order
        src, dst = [], []
        cut = np.flatnonzero(np.concatenate(([True], np.diff(unit[order]) != 0, [True])))
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            own = order[lo:hi]
            if len(own) > 1:
                two = side[own] if (side[own] != side[own[0]]).any() else None
                if two is None and side[own[0]] >= 2:
                    continue  # a pair of blocks of which one is empty
                for p, q in Tree([sets[i] for i in own]).links(percent, two, label[own]):
                    src.append(node[own[p]])
                    dst.append(node[own[q]])
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return run


def _pairs_of_blocks(large: DataFrame, limit: int, percent: int) -> DataFrame:
    """Deal nodes of clusters over ``limit`` into pairs of blocks: unit, side, node, label."""
    large = large.withColumn("band", F.floor(F.log("n") / math.log(_band(percent))).cast("int"))
    # a linked pair is in one band or two next to each other; blocks cut a band
    bands = large.groupBy("cluster", "band").agg(F.ceil(F.sum("n") / limit).cast("int").alias("blocks"))
    large = large.join(bands, ["cluster", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    near = bands.select("cluster", F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias("d"), F.col("band").alias("own"), F.col("blocks").alias("other"))
    near = near.select("cluster", (F.col("own") + F.col("d")).alias("band"), "other", (-F.col("d")).alias("step"))
    pairs = large.join(near, ["cluster", "band"]).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("other") - 1)))
    # a unit is named by its lower block first
    mine, yours = F.struct(F.col("band").alias("b"), F.col("block").alias("k")), F.struct((F.col("band") + F.col("step")).alias("b"), F.col("j").alias("k"))
    low, high = F.least(mine, yours), F.greatest(mine, yours)
    side = F.when(mine == yours, 0).when(mine < yours, 2).otherwise(3)
    return pairs.select(F.xxhash64("cluster", low, high).alias("unit"), side.alias("side"), "node", "label")


def _split(nodes: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Units of the clusters up to ``limit`` n-grams, and the nodes of larger ones. ``nodes`` has cluster, node, n, label."""
    whole = nodes.groupBy("cluster").agg(F.sum("n").alias("all"), F.count("*").alias("members")).where("members > 1")
    rows = nodes.join(whole, "cluster")
    small = rows.where(F.col("all") <= limit).select(F.xxhash64("cluster").alias("unit"), F.lit(0).alias("side"), "node", "label")
    return small, rows.where(F.col("all") > limit).select("cluster", "node", "n", "label")


def _tree_links(units: DataFrame, sets: DataFrame, groups: int, percent: int) -> DataFrame:
    """Links found in units; units of one side are put together into ``groups`` tasks."""
    keyed = units.withColumn("group", F.when(F.col("side") >= 2, F.col("unit")).otherwise(F.pmod("unit", F.lit(groups)))).join(sets.select("node", "tokens"), "node")
    return keyed.groupBy("group").applyInArrow(lean(_join_group(percent)), "src long, dst long")


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with the component that ``links`` give as label."""
    found = components(links).select("node", F.col("component").alias("label"))
    return nodes.drop("label").join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _large_links(large: DataFrame, sets: DataFrame, prefixes: DataFrame, limit: int, percent: int) -> DataFrame:
    """Links that span the components of clusters over ``limit`` n-grams."""
    own = large.select("node", "cluster")
    marked = sets.join(own.select("node"), "node", "left_semi").select("node", "n", "tokens").mapInArrow(_marks, "node long, n long, marks array<long>")
    rows = settle(marked.join(own, "node").withColumn("label", F.col("node")))
    links = None
    for r in range(ROUNDS):
        # one node of each component and mark stands for the others
        one = rows.select("cluster", "node", "n", "label", F.col("marks")[r].alias("mark")).groupBy("cluster", "label", "mark").agg(F.min(F.struct("node", "n")).alias("one"))
        one = one.select("cluster", "label", "mark", "one.node", "one.n")
        size = one.groupBy("cluster", "mark").agg(F.ceil(F.sum("n") / limit).cast("int").alias("parts"), F.count("*").alias("members")).where("members > 1")
        part = F.pmod(F.xxhash64("node", F.lit(r)), F.col("parts"))
        units = one.join(size, ["cluster", "mark"]).select(F.xxhash64("cluster", "mark", part).alias("unit"), F.lit(0).alias("side"), "node", "label", "n")
        groups = max(1, 2 * (units.agg(F.sum("n")).first()[0] or 0) // limit)
        found = _tree_links(units.drop("n"), sets, groups, percent)
        links = settle(found if links is None else links.unionByName(found))
        rows = settle(_labelled(rows, links))
    entries = prefixes.mapInArrow(_unpack_prefixes, "token long, node long").join(rows.select("node", "label"), "node")
    several = entries.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.min("node").alias("dst")).where("a <> b").select("token", "dst")
    again = components(settle(entries.join(several, "token").select(F.col("node").alias("src"), "dst").distinct()))
    small, rest = _split(rows.select("node", "n", "label").join(again, "node").withColumnRenamed("component", "cluster"), limit)
    units = small.unionByName(_pairs_of_blocks(rest, limit, percent))
    groups = max(1, 2 * (rows.agg(F.sum("n")).first()[0] or 0) // limit)
    return links.unionByName(_tree_links(units, sets, groups, percent))


def join(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT, limit: int = LIMIT, block_text: int = BLOCK_TEXT, count_block: int = COUNT_BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    spark = docs.sparkSession
    with arrow_rows(spark):
        rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        blocks = max(1, total // block_text)
        dealt = rows.mapInArrow(lean(_deal(n, blocks)), DEALT_SCHEMA)
        told = settle_table(dealt.groupBy("block").applyInArrow(lean(_shared(blocks)), DEALT_SCHEMA))
        del dealt
        release(spark)
        described = settle(told.where("ids is not null").mapInArrow(_unpack_told, "doc_id long, n long, sampled long, node long"))
        nodes = described.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("sampled").alias("sampled"))
        shared = told.where("ids is null").select("block", "nodes", "counts").groupBy("block").applyInArrow(_sum_shared, "node long, shared long")
        may_lack = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100)
        left = nodes.join(shared, "node", "left").where((F.col("sampled") - F.coalesce("shared", F.lit(0)) <= may_lack)).select("node", "least", "n")
        left = settle(left)
        discard(spark, told)
        count, entries = left.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * count).bit_length()))
        bits_of_left = spark.sparkContext.broadcast(bitmap(left, "least", bits))
        hashed = rows.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("at"), "text")
        # the bitmap lets a few other nodes through; they cost a comparison and link with nothing
        sets = settle_table(hashed.mapInArrow(lean(_sets(n, bits_of_left)), "node long, n long, tokens binary"))
        blocks = max(1, entries // count_block)
        counted = sets.mapInArrow(lean(_deal_sets(blocks)), "block int, nodes binary, counts binary, tokens binary, sizes binary").groupBy("block").applyInArrow(lean(_count(blocks)), COUNTED)
        prefixes = settle_table(counted.groupBy("home").applyInArrow(lean(_prefixes(percent, blocks)), "block int, tokens binary, nodes binary, sizes binary"))
        del counted
        release(spark)
        clusters = components(prefixes.groupBy("block").applyInArrow(lean(_meet(percent)), "src long, dst long"))
        met = sets.select("node", "n").distinct().join(clusters, "node").withColumnRenamed("component", "cluster").withColumn("label", F.col("node"))
        small, large = _split(met, limit)
        large = settle(large)
        links = _tree_links(small, sets, max(1, 2 * entries // limit), percent)
        if not large.isEmpty():
            links = links.unionByName(_large_links(large, sets, prefixes, limit, percent))
        joined = components(links)
        names = joined.join(nodes.select("node", "least"), "node")
        lowest = settle(names.groupBy("component").agg(F.min("least").alias("component_id")))
        discard(spark, sets, prefixes)
        # settled tables, so that the joins can deal out a component of very many nodes and a node of very many copies
        linked = joined.join(lowest, "component").select("node", "component_id")
        own = settle(nodes.join(linked, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id")))
        return described.join(own, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
