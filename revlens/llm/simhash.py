"""SimHash near-dedup: small-world graphs over Hamming distance, one for each shard; all queries to all shards; verified edges."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, hash_range, lean, mix, sliced, word_hashes, words, written
from .components import components

#: Bits of a signature that near copies may differ in; share of words that they have in common at least.
BITS, RADIUS, SHARE = 128, 30, 0.6
#: Nodes of a shard, about: at most (what a task holds), and at least where there are tasks enough for more shards.
SHARD, LEAST = 1 << 18, 1 << 16
#: Words whose lanes are summed at once; fewer than a lane of 16 bits counts to.
COUNTED = 60_000
#: Orders of a shard's signatures, neighbours compared to either side in each, links to near nodes, beam to begin with and at its widest.
ORDERS, WINDOW, LINKS, BEAM, WIDEST = 128, 1, 8, 8, 64
#: Signatures that are audited by exact search at first and at most, and the recall asked of the search.
AUDITED, MOST_AUDITED, RECALL = 256, 4096, 0.95
#: Audited signatures that are compared to a batch at once.
COMPARED = 32
#: Near copies of a signature in a small group, at most; so many of such signatures are to be audited.
SMALL, ENOUGH = 8, 256
#: Bits that an order sorts by; queries of a block, about, where there are so many.
SORTED, QUERIES = 32, 1 << 20
#: The search is repeated with up to so many orders; then all pairs are compared, in blocks of so many signatures.
MOST_ORDERS, BLOCK = 256, 1 << 15

SECOND = np.uint64(0x9E3779B97F4A7C15)
NONE = np.int64(255 << 32 | 0xFFFFFFFF)
SIGNATURE = pa.schema([("doc_id", pa.int64()), ("body", pa.int64()), ("id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("words", pa.binary())])
EDGES = "a bigint, b bigint, nr int"


def _simhashes(hashes: np.ndarray, word: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The majority of each bit among the words of each document, by sums of 16-bit lanes, four in an integer."""
    lanes = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.uint16).view(np.uint64)
    votes = np.empty((len(starts), 64), np.int64)
    a, most = 0, COUNTED
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + most, side="right")))
        if ends[b - 1] - starts[a] <= most:
            votes[a:b] = np.add.reduceat(lanes[word[starts[a] : ends[b - 1]]], starts[a:b] - starts[a], axis=0).view(np.uint16)
        else:
            votes[a] = sum(lanes[word[x : min(ends[a], x + most)]].sum(axis=0, dtype=np.uint64).view(np.uint16).astype(np.int64) for x in range(starts[a], ends[a], most))
        a = b
    return np.packbits(2 * votes > (ends - starts)[:, None], axis=1).reshape(-1).view(">u8").astype(np.uint64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SimHash of 128 bits over each document's set of words (lower case, without punctuation around), the set itself as sorted 32-bit hashes, and the set's hash."""
    for batch in sliced(batches, "text"):
        vocabulary, codes, offsets = words(batch.column("text"))
        plain = [w.lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~…“”„«»¿¡") for w in vocabulary]
        hashes, same = np.unique(word_hashes(plain), return_inverse=True)  # in order, so that a place is in order of hashes
        void = np.searchsorted(hashes, word_hashes([""])[0])
        void = int(void) if void < len(hashes) and "" in plain else -1
        size = max(1, len(hashes))
        pair = np.sort(np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) * size + same[codes]) if len(codes) else np.array([], np.int64)
        pair = pair[np.concatenate(([True], pair[1:] != pair[:-1]))] if len(pair) else pair
        pair = pair[pair % size != void]
        doc, word = pair // size, pair % size
        starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.array([], np.int64)
        ends = np.append(starts[1:], len(doc))
        short = (hashes >> np.uint64(32)).astype(np.uint32)[word]
        sets = [short[a:b].tobytes() for a, b in zip(starts, ends)]
        h = [_simhashes(x, word, starts, ends).view(np.int64) for x in (hashes, mix(hashes ^ SECOND))]
        ids = [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in sets]
        at = pa.array(doc[starts] if len(starts) else np.array([], np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("body").take(at), pa.array(ids, pa.int64()), *map(pa.array, h), pa.array(sets, pa.binary())], schema=SIGNATURE)


@functools.cache
def _tables(t: int) -> np.ndarray:
    """For each byte of a signature and its value, the bits that it gives to the keys of order t."""
    out = np.zeros((BITS // 8, 256), np.uint32)
    for place, bit in enumerate(np.random.default_rng(1000 + t).permutation(BITS)[:SORTED].tolist()):
        out[bit // 8, np.arange(256) >> (7 - bit % 8) & 1 == 1] |= np.uint32(1 << (SORTED - 1 - place))
    return out


def _bytes(h: np.ndarray) -> np.ndarray:
    """A row for each byte of the signatures."""
    return np.ascontiguousarray(h.astype(">u8").view(np.uint8).reshape(-1, BITS // 8).T)


def permuted(columns: np.ndarray, t: int) -> np.ndarray:
    """SORTED bits of the signatures with these bytes, in the order of table t, as integers to sort by."""
    tables = _tables(t)
    out = tables[0][columns[0]]
    for table, column in zip(tables[1:], columns[1:]):
        out |= table[column]
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that signatures (two integers each, in the last axis) differ in."""
    return np.bitwise_count(a[..., 0] ^ b[..., 0]) + np.bitwise_count(a[..., 1] ^ b[..., 1])


def _keys(d: np.ndarray, node: np.ndarray) -> np.ndarray:
    return d.astype(np.int64) << 32 | node.astype(np.int64)


def _nearest(keys: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distinct keys (distance, node) of each row, in order."""
    keys.sort(axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = NONE
    if keys.shape[1] > k:
        keys = np.partition(keys, k - 1, axis=1)[:, :k]
    keys.sort(axis=1)
    return keys


class Graph:
    """A navigable small world over a shard's distinct signatures: links to near nodes, and far ones at powers of two of a sorted order."""

    def __init__(self, h: np.ndarray, orders: int = ORDERS):
        n = len(h)
        self.h, self.sorted, self.place = h, [], []
        best = np.full((n, LINKS), NONE)
        columns = _bytes(h)
        for first in range(0, orders, 8):  # so many at once are merged into the nearest so far
            near = [best]
            for t in range(first, min(orders, first + 8)):
                key = permuted(columns, t)
                place = np.argsort(key, kind="stable").astype(np.int32)
                self.sorted.append(key[place])
                self.place.append(place)
                s = h[place]
                for off in range(1, min(WINDOW, n - 1) + 1):
                    d = distance(s[:-off], s[off:])
                    for here, there in ((place[:-off], place[off:]), (place[off:], place[:-off])):
                        near.append(np.full((n, 1), NONE))
                        near[-1][here, 0] = _keys(d, there)
            best = np.concatenate([_nearest(np.concatenate([x[a : a + (1 << 15)] for x in near], axis=1), LINKS) for a in range(0, n, 1 << 15)]) if n else best
        node = self._nodes(best)
        for a in range(0, n, 1 << 14):  # the links' links are near, too
            mine = np.arange(a, min(n, a + (1 << 14)))
            more = node[node[mine]].reshape(len(mine), -1)
            keys = np.where(more == mine[:, None], NONE, _keys(distance(h[mine][:, None], h[more]), more))
            best[mine] = _nearest(np.concatenate((best[mine], keys), axis=1), LINKS)
        rank = np.empty(n, np.int64)
        if n:
            rank[self.place[0]] = np.arange(n)
        far = [self.place[0][(rank + (1 << s)) % n][:, None] for s in range(3, max(4, n.bit_length()), 3)] if n else []
        self.links = np.concatenate([self._nodes(best), *far], axis=1).astype(np.int32)

    def _nodes(self, keys: np.ndarray) -> np.ndarray:
        """The nodes of keys; a node itself where it has fewer."""
        return np.where(keys == NONE, np.arange(len(keys))[:, None], keys & 0xFFFFFFFF)

    def search(self, q: np.ndarray, own: np.ndarray, beam: int, start: np.ndarray | None = None) -> np.ndarray:
        """For each query the keys (distance, node) of the nearest nodes that a beam finds, NONE where there are fewer.

        own: the node that is the query itself, or -1. A beam starts at the query's neighbours in each order, or from start.
        """
        n = len(self.h)
        if start is None:
            columns = _bytes(q)
            at = [np.searchsorted(s, permuted(columns, t)) for t, s in enumerate(self.sorted)]
            new = np.concatenate([p[np.clip(x[:, None] + np.arange(-WINDOW, WINDOW), 0, n - 1)] for p, x in zip(self.place, at)], axis=1)
        else:
            new = np.where(start == NONE, -1, start & 0xFFFFFFFF).astype(np.int32)
        beams = np.full((len(q), beam), NONE)
        active = np.arange(len(q))
        while len(active):
            keys = np.where((new < 0) | (new == own[active][:, None]), NONE, _keys(distance(q[active][:, None], self.h[new]), new))
            keys = _nearest(np.concatenate((beams[active], keys), axis=1), beam)
            better = (keys != beams[active]).any(axis=1)
            beams[active] = keys
            active, keys = active[better], keys[better]
            new = np.where((keys == NONE)[:, :, None], -1, self.links[np.where(keys == NONE, 0, keys & 0xFFFFFFFF)]).reshape(len(active), beam * self.links.shape[1])
        return beams


def _linked(h: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, radius: int, orders: int) -> list[np.ndarray]:
    """Rows (a, b, nr) of what the queries find within the radius in a shard; nr counts from the nearest.

    Beams double as long as all in them is within the radius. Where the widest is full, too, there is a row (a, a, 0).
    """
    graph = Graph(h, orders)
    order = np.argsort(ids)
    place = order[np.minimum(np.searchsorted(ids[order], q_ids), len(ids) - 1)] if len(ids) else np.zeros(0, np.int64)
    own = np.where(ids[place] == q_ids, place, -1)
    out = [np.zeros((3, 0), np.int64)]
    for a in range(0, len(q) if len(ids) else 0, 1 << 12):
        mine, width, start = np.arange(a, min(len(q), a + (1 << 12))), BEAM, None
        while len(mine):
            step = max(1, (1 << 14) // width)
            found = np.concatenate([graph.search(q[mine[x : x + step]], own[mine[x : x + step]], width, None if start is None else start[x : x + step]) for x in range(0, len(mine), step)])
            full = found[:, -1] >> 32 <= radius
            done = ~full if width < WIDEST else np.ones(len(mine), bool)
            i, j = np.nonzero((found >> 32 <= radius) & done[:, None])
            x, y = q_ids[mine[i]], ids[found[i, j] & 0xFFFFFFFF]
            out.append(np.stack((np.minimum(x, y), np.maximum(x, y), j + 1)))
            if width >= WIDEST:
                dense = q_ids[mine[full]]
                out.append(np.stack((dense, dense, np.zeros(len(dense), np.int64))))
            mine, start, width = mine[~done], found[~done], 2 * width
    return out


def _edges(rows: list[np.ndarray]) -> pa.RecordBatch:
    a, b, nr = np.concatenate(rows, axis=1)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(nr.astype(np.int32))], names=["a", "b", "nr"])


def _columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    parts = [[b.column(c).to_numpy(zero_copy_only=False) for c in names] for b in batches]
    return [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64) for _ in names]


def _pair(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return np.stack((h1.view(np.uint64), h2.view(np.uint64)), axis=1)


def candidates(nodes: DataFrame, radius: int = RADIUS, orders: int = ORDERS) -> DataFrame:
    """(a, b, nr): pairs of ids whose signatures are within the radius, and (a, a, 0) for ids with more such than a beam holds.

    nodes: id (uniform over 64 bits), h1, h2. Nodes are in shards by id, of SHARD at most, about; all are queries, too, in
    blocks. Each (shard, block) is a task, which builds the shard's graph and searches it for the block's queries.
    """
    n, spark = nodes.count(), nodes.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    shards = max(1, math.ceil(n / SHARD), min(math.isqrt(tasks), n // LEAST))
    blocks = max(math.ceil(n / QUERIES), math.ceil(tasks / shards))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = batch.column("shard").to_numpy(zero_copy_only=False).astype(np.int32)
            block = batch.column("block").to_numpy(zero_copy_only=False).astype(np.int32)
            for role, cells in (*((0, shard * blocks + x) for x in range(blocks)), *((1, x * blocks + block) for x in range(shards))):
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(np.full(len(cells), role, np.int32)), *(batch.column(c) for c in ("id", "h1", "h2"))], names=["cell", "role", "id", "h1", "h2"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        role, ids, h1, h2 = _columns(batches, ["role", "id", "h1", "h2"])
        if len(ids):
            order = np.argsort(ids, kind="stable")  # the same edges whatever the order of arrival
            role, ids, h = role[order], ids[order], _pair(h1, h2)[order]
            yield _edges(_linked(h[role == 0], ids[role == 0], h[role == 1], ids[role == 1], radius, orders))

    placed = nodes.select("id", "h1", "h2", hash_range(F.col("id"), shards).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    cells = placed.mapInArrow(lean(route), "cell int, role int, id bigint, h1 bigint, h2 bigint").repartitionById(shards * blocks, F.col("cell"))
    return cells.mapInArrow(lean(link), EDGES).groupBy("a", "b").agg(F.min("nr").alias("nr"))


def every_pair(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b, nr): all pairs of ids of different components whose signatures are within the radius, by comparing each block to each.

    nodes: id, h1, h2, component. Blocks are ranges of components, so that those within one component are passed over.
    """
    spark = nodes.sparkSession
    n = max(1, math.ceil(nodes.count() / BLOCK))
    placed = nodes.repartitionByRange(n, "component", "id").withColumn("block", F.spark_partition_id())

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.column("block").to_numpy(zero_copy_only=False).astype(np.int64)
            for other in range(n):
                cell = np.minimum(mine, other) * n + np.maximum(mine, other)
                yield pa.RecordBatch.from_arrays([pa.array(cell), *(batch.column(c) for c in ("block", "id", "h1", "h2", "component"))], names=["cell", "block", "id", "h1", "h2", "component"])

    def compare(cell: pa.Table) -> pa.Table:
        block, ids, h1, h2, component = (cell.column(c).to_numpy() for c in ("block", "id", "h1", "h2", "component"))
        h = _pair(h1, h2)
        first, second = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        out = [np.zeros((3, 0), np.int64)]
        if component.min() != component.max():
            step = max(1, (1 << 21) // len(second))
            for i in range(0, len(first), step):
                q = first[i : i + step]
                x, y = np.nonzero((distance(h[q][:, None], h[second][None]) <= radius) & (component[q][:, None] != component[second][None]))
                a, b = ids[q[x]], ids[second[y]]
                out.append(np.stack((np.minimum(a, b), np.maximum(a, b), np.ones(len(a), np.int64))))
        return pa.Table.from_batches([_edges(out)])

    return placed.mapInArrow(lean(route), "cell bigint, block int, id bigint, h1 bigint, h2 bigint, component bigint").groupBy("cell").applyInArrow(compare, EDGES).distinct()


def similar(x: bytes, y: bytes, share: float) -> bool:
    """Whether two sets of words (sorted hashes) have at least this Jaccard similarity."""
    p, q = len(x) // 4, len(y) // 4
    if min(p, q) < share * max(p, q):
        return False
    both = np.concatenate((np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common >= share * (p + q - common)


def verified(signed: DataFrame, pairs: DataFrame, share: float) -> DataFrame:
    """The pairs (a, b) whose whole sets of words are similar; only the sets of ids in pairs are shuffled."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(x, y, share) for x, y in zip(batch.column("words_a").to_pylist(), batch.column("words_b").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = pairs.select("a", "b").where("a <> b")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = signed.select("id", "words").join(needed, "id", "left_semi").groupBy("id").agg(F.first("words").alias("words"))
    sides = [sets.select(F.col("id").alias(x), F.col("words").alias("words_" + x)) for x in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "words_a", "words_b").mapInArrow(lean(check), "a bigint, b bigint")


def _labelled(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """pairs with the components of both ends; an id without a group is its own."""
    for x in "ab":
        side = groups.select(F.col("node").alias(x), F.col("component").alias("of_" + x))
        pairs = pairs.join(side, x, "left").withColumn("of_" + x, F.coalesce("of_" + x, x))
    return pairs


def grouped(signed: DataFrame, nodes: DataFrame, found: DataFrame, radius: int, share: float) -> DataFrame:
    """(node, component) by the verified pairs of found (a, b, nr), a written table.

    First each node's nearest are verified, then, of all other pairs, those whose ends are still apart; what is in one
    component already needs no verification. Ids with more near signatures than the widest beam are at last compared
    exactly to all others of that kind in other components (to ids of any other kind, they are linked by these).
    """
    held = written(verified(signed, found.where("nr BETWEEN 1 AND 2"), share), "simhash")
    groups = components(held)
    apart = _labelled(found.where("nr > 2").select("a", "b"), groups).where("of_a <> of_b")
    more = written(verified(signed, apart, share), "simhash")
    groups = components(held.union(more))
    dense = found.where("nr = 0").select(F.col("a").alias("id"))
    if not dense.isEmpty():
        dense = nodes.join(dense, "id").join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        groups = components(held.union(more).union(written(verified(signed, every_pair(written(dense, "simhash"), radius), share), "simhash")))
    return groups


def audit(signed: DataFrame, nodes: DataFrame, groups: DataFrame, radius: int, share: float) -> float:
    """The share of a signature's near copies that are in its group, as a mean over signatures that have some.

    The mean is taken apart over signatures in small groups and in others, so that neither hide the other's losses, and the
    lesser counts. More signatures are audited until ENOUGH of them are in small groups, up to MOST_AUDITED. If none of
    those has a near copy, there is nothing to lose but what fewer than 1 in 1000 documents have, and the result is 1.
    """
    audited = AUDITED
    while True:
        sample = np.array([(r["id"], r["h1"], r["h2"]) for r in nodes.orderBy(F.xxhash64("id"), "id").limit(audited).collect()], np.int64).reshape(-1, 3)

        def compare(batches: Iterator[pa.RecordBatch], sample: np.ndarray = sample) -> Iterator[pa.RecordBatch]:
            q = _pair(sample[:, 1].copy(), sample[:, 2].copy())
            for batch in batches:
                ids, h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "h1", "h2"))
                h = _pair(h1, h2)
                for k in range(0, len(q), COMPARED):
                    x, y = np.nonzero(distance(q[k : k + COMPARED][:, None], h[None]) <= radius)
                    yield pa.RecordBatch.from_arrays([pa.array(sample[x + k, 0]), pa.array(ids[y])], names=["a", "b"])

        true = verified(signed, nodes.mapInArrow(lean(compare), "a bigint, b bigint"), share)
        each = _labelled(true, groups).groupBy("a").agg(F.count("*").alias("n"), F.count_if(F.col("of_a") == F.col("of_b")).alias("hit"))
        found = each.groupBy((F.col("n") <= SMALL).alias("small")).agg(F.count("*").alias("n"), F.avg(F.col("hit") / F.col("n")).alias("recall")).collect()
        if audited >= MOST_AUDITED or len(sample) < audited or sum(r["n"] for r in found if r["small"]) >= ENOUGH:
            return min((r["recall"] for r in found), default=1.0)
        audited *= 4


def _members(docs: DataFrame, radius: int, share: float) -> DataFrame:
    """(doc_id, body, component) of each distinct document (doc_id and hash of the text) with a word; a written table."""
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("body"), text.alias("text"))
    signed = written(base.mapInArrow(lean(_signatures), "doc_id bigint, body bigint, id bigint, h1 bigint, h2 bigint, words binary"), "simhash")
    nodes = written(signed.select("id", "h1", "h2").groupBy("id").agg(F.min("h1").alias("h1"), F.min("h2").alias("h2")), "simhash")
    orders = ORDERS
    while True:
        found = written(candidates(nodes, radius, orders), "simhash")
        groups = grouped(signed, nodes, found, radius, share)
        discard(found)
        if audit(signed, nodes, groups, radius, share) >= RECALL:
            break
        orders *= 2
        if orders > MOST_ORDERS:  # all nodes, each a component of its own so far
            found = written(every_pair(nodes.withColumn("component", F.col("id")), radius), "simhash")
            groups = components(verified(signed, found, share))
            break
    members = signed.select("doc_id", "body", "id").distinct().join(groups, F.col("id") == F.col("node"), "left")
    out = written(members.select("doc_id", "body", F.coalesce("component", "id").alias("component")), "simhash")
    discard(signed, nodes, groups)
    return out


def near_duplicates(docs: DataFrame, radius: int = RADIUS, share: float = SHARE) -> DataFrame:
    """(doc_id, group_id): the documents that have near copies; group_id is the smallest doc_id of the group.

    Documents are near copies if their SimHashes differ in at most radius of 128 bits and the Jaccard similarity of their
    whole sets of words is at least share; groups are what is connected by such pairs. Words are in lower case, without
    punctuation around them. Texts with the same set of words are one node of the search. The search is approximate; it is
    audited by exact search for a sample, and repeated with more orders and at last by comparing all pairs, so that no
    recall below RECALL is returned.

    A document is a distinct (doc_id, text): repeated rows are one; rows with the same doc_id and different texts are
    documents of their own, so that a doc_id has a row for each group that it is in. Rows without doc_id are documents,
    too, and can make another one's group, but are not listed. Null and empty texts, and those without a word (only
    punctuation), are in no group. Long texts are compared whole. Ties in distance go by the hash of the set of words; the
    groups don't depend on them. An empty table gives an empty result. Other columns are not read.
    """
    members = _members(docs, radius, share)
    large = members.groupBy("component").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n")).where("n > 1 AND group_id IS NOT NULL").drop("n")
    return members.where("doc_id IS NOT NULL").join(large, "component").select("doc_id", "group_id").distinct()


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, share: float = SHARE) -> DataFrame:
    """The documents without near copies, see near_duplicates(), but for one of each group; all columns stay.

    The one that stays has the smallest doc_id (rows without doc_id come last; ties go by the hash of the text). What goes
    is known by doc_id and text, so that a row with the same doc_id and a text of its own stays. Repeated rows of what
    stays all stay. Null and empty texts stay. An empty table gives an empty result; names of other columns don't matter.
    """
    gone_id, gone_body = fresh(docs, "near_copy"), fresh(docs, "near_copy_body")
    members = _members(docs, radius, share)
    first = members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")).alias("first"))
    gone = members.join(first, "component").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("body") == F.col("first.body"))))
    gone = written(gone.select(F.col("doc_id").alias(gone_id), F.col("body").alias(gone_body)), "simhash")  # so that its size is known to the optimizer
    same = (F.xxhash64(F.col("text").cast("string")) == F.col(gone_body)) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(gone_id))
    return docs.join(gone, same, "left_anti")
