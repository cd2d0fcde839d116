"""Suffix-array dedup: passages that occur more than once, from merged Burrows-Wheeler transforms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_range, mix, partitions, sliced, word_hashes, words, written

#: Words of the shortest passage.
LEAST = 50
#: Segments whose transform is built at once, and symbols merged at once, about.
SHARD, MERGED = 256, 60_000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) of each window of x."""
    span = 1
    while 2 * span <= width:
        x = f(x[:-span], x[span:])
        span *= 2
    return f(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def anchors(h: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's word hashes: positions, hashes and segment hashes of its anchors.

    An anchor is a run of half of `least` words whose hash is the smallest of a window of such runs; the choice depends on
    the window's words alone, and any passage of `least` words has an anchor whole in it, the same wherever it stands. Its
    segment is what any such passage may reach over: half of `least` words before it, and `least` from its start.
    """
    gram, n = least // 2, len(h)
    p, q = _powers(BASE, n + 1), _powers(INVERSE, n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * p[:n], dtype=np.uint64)))

    def run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((sums[b] - sums[a]) * q[a])

    at = np.arange(n - gram + 1)
    value = run(at, at + gram)
    window = least - gram + 1
    low = sliding(value, window, np.minimum)
    most = np.full(len(value) + window - 1, np.uint64(0))
    most[window - 1 : window - 1 + len(low)] = low
    chosen = np.flatnonzero(sliding(most, window, np.maximum) == value)
    a, b = np.maximum(chosen - (least - gram), 0), np.minimum(chosen + least, n)
    return chosen, value[chosen], mix(run(a, b) + ((chosen - a) * 1_000_003 + (b - a)).astype(np.uint64))


def transform(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a shard's texts, each ending with a symbol of its own, and the transform: what stands before each suffix, the own end before a text's start."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    last = np.repeat(ends, np.diff(np.concatenate(([-1], ends))))  # the end of each position's text
    step = 1
    while True:
        ahead = np.minimum(np.arange(n) + step, last)
        key = rank * (n + 1) + np.where(np.arange(n) + step <= last, rank[ahead] + 1, 0)
        new = np.unique(key, return_inverse=True)[1]
        if new.max(initial=0) == n - 1:
            break
        rank, step = new, 2 * step
    order = np.argsort(new, kind="stable")
    starts = np.concatenate(([0], ends[:-1] + 1))
    before = np.arange(n) - 1
    before[starts] = ends
    return order, symbols[before[order]]


def interleave(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges transforms: the shard of each suffix in the common order by its first `depth` symbols, and common prefixes.

    Each round orders by one symbol more: the transforms are read as they are interleaved, and each suffix's shard goes to
    the place of the symbol read, as in a stable counting sort; no suffix is compared. lcp: of how many symbols, depth at
    most, a suffix's common prefix with the one before is, known from the round in which the two fell apart.
    """
    every = np.concatenate(transforms)
    shard = np.repeat(np.arange(len(transforms)), [len(t) for t in transforms]).astype(np.uint16 if len(transforms) <= 1 << 16 else np.uint32)
    n = len(every)
    small = np.uint16 if every.max(initial=0) < 1 << 16 else np.int64
    every = every.astype(small)
    lcp = np.full(n, depth, np.int64)
    if n:
        lcp[0] = 0
    block = np.zeros(n, np.int64)
    for round_ in range(depth):
        read = np.empty(n, small)
        read[np.argsort(shard, kind="stable")] = every
        order = np.argsort(read, kind="stable")
        symbol, tail = read[order], block[order]
        shard = shard[order]
        apart = np.concatenate(([True], (symbol[1:] != symbol[:-1]) | (tail[1:] != tail[:-1])))
        lcp[apart & (lcp == depth)] = round_
        block = np.cumsum(apart) - 1
    return shard, lcp


def repeated(segments: list[np.ndarray], copies: np.ndarray, places: list[tuple], offsets: np.ndarray, least: int) -> list[np.ndarray]:
    """For each segment (word symbols), the places in it from which `least` words occur elsewhere, too.

    Only places whose passage holds the segment's anchor (at offsets) are asked for. A segment with copies occurs
    elsewhere whole; places are (document, position of the anchor), by which an occurrence is told from itself.
    """
    count = len(segments)
    names = np.unique(np.concatenate(segments), return_inverse=True)[1] + count
    sizes = np.array([len(s) for s in segments])
    ends = np.cumsum(sizes + 1) - 1
    text = np.empty(ends[-1] + 1, np.int64)
    of = np.repeat(np.arange(count), sizes + 1)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = names
    text[ends] = np.arange(count)
    arrays, transforms, cut = [], [], np.arange(0, count, SHARD)
    for a in cut:
        b = min(count, a + SHARD)
        lo = ends[a - 1] + 1 if a else 0
        sa, bwt = transform(text[lo : ends[b - 1] + 1], ends[a:b] - lo)
        arrays.append(sa + lo)
        transforms.append(bwt)
    shard, lcp = interleave(transforms, least)
    suffix = np.empty(len(text), np.int64)
    suffix[np.argsort(shard, kind="stable")] = np.concatenate(arrays)
    interval = np.cumsum(lcp < least)
    seg = of[suffix]
    start = suffix - (ends - sizes)[seg]
    # an end symbol is its text's alone, so that what is alike in `least` symbols lies within its segment
    fits = (start + least <= sizes[seg]) & (start <= offsets[seg]) & (start + least >= offsets[seg] + least // 2)
    interval, seg, start = interval[fits], seg[fits], start[fits]
    doc = {}
    document = np.array([doc.setdefault(p[0], len(doc)) for p in places])
    place = document[seg] * (1 << 44) + np.array([p[1] for p in places], np.int64)[seg] + start - offsets[seg]
    own = np.unique(np.stack((interval, place), axis=1), axis=0) if len(seg) else np.zeros((0, 2), np.int64)
    distinct = np.bincount(own[:, 0], minlength=len(text) + 2)
    many = np.bincount(interval, copies[seg] > 1, minlength=len(text) + 2) > 0
    good = (distinct[interval] > 1) | many[interval]
    order = np.argsort(seg[good], kind="stable")
    return np.split(start[good][order], np.searchsorted(seg[good][order], np.arange(1, count)))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, start, end, n_words): the parts of each document that passages of `least` words which occur more than once cover.

    Words are what ASCII white space separates, compared by hash; start and end count words from 0, end exclusive. An
    occurrence may be in the same document, elsewhere in it. Parts are as long as they can be.

    Documents with fewer than `least` words (null and empty ones, too) have none. Each distinct (doc_id, text) is one
    document; rows without doc_id with different texts are documents of their own, and so are rows with the same doc_id
    and different texts, whose parts all carry that doc_id. An empty table gives an empty result. Other columns are not
    read.

    Only what is around repeated anchors is compared (see anchors(); no passage is missed), and equal segments are one.
    The segments go to ranges of their anchors' hashes; there each shard's transform is built, and the shards are merged.
    """
    n, half = partitions(docs.sparkSession), least - least // 2
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("body"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            vocabulary, codes, offsets = words(batch.column("text"))
            hashes = word_hashes(vocabulary)
            rows = np.flatnonzero(np.diff(offsets) >= least)
            found = [anchors(hashes[codes[offsets[i] : offsets[i + 1]]], least) for i in rows]
            if not found:
                continue
            pos, anchor, seg = (np.concatenate(x) for x in zip(*found))
            sizes = [len(f[0]) for f in found]
            at = pa.array(np.repeat(rows, sizes))
            after = np.minimum(pos + least, np.repeat(np.diff(offsets)[rows], sizes)) - pos
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(seg.view(np.int64)), batch.column("doc_id").take(at), batch.column("body").take(at), *(pa.array(x.astype(np.int32)) for x in (pos, np.minimum(pos, half), after))], names=["anchor", "seg", "doc_id", "body", "pos", "before", "after"])

    held = base.mapInArrow(find, "anchor bigint, seg bigint, doc_id bigint, body bigint, pos int, before int, after int")
    by = Window.partitionBy("anchor")
    again = written(held.withColumn("n", F.count("*").over(by)).where("n > 1").drop("n"), "suffixes").distinct()
    segs = again.groupBy("anchor", "seg", "before", "after").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "body", "pos")).alias("one"))
    segs = written(segs.withColumn("kinds", F.count("*").over(by)).where("copies > 1 OR kinds > 1"), "suffixes")

    # the words of one copy of each segment that isn't alone
    wanted = segs.where("kinds > 1").select("one.doc_id", "one.body", F.struct("one.pos", "before", "anchor", "seg", "copies").alias("s")).groupBy("doc_id", "body").agg(F.collect_list("s").alias("segs"))
    wanted = wanted.select(F.col("doc_id").alias("w_doc_id"), F.col("body").alias("w_body"), "segs")
    texts = base.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_doc_id")) & (F.col("body") == F.col("w_body"))).select("doc_id", "body", "text", "segs")
    kinds = (("anchor", pa.int64()), ("seg", pa.int64()), ("copies", pa.int64()), ("doc_id", pa.int64()), ("body", pa.int64()), ("pos", pa.int32()), ("before", pa.int32()), ("h", pa.binary()))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            vocabulary, codes, offsets = words(batch.column("text"))
            short = word_hashes(vocabulary).astype(np.uint32)
            rows = []
            for i, (doc, body, want) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "body", "segs")))):
                mine = short[codes[offsets[i] : offsets[i + 1]]]
                for s in want:
                    rows.append((s["anchor"], s["seg"], s["copies"], doc, body, s["pos"], s["before"], mine[s["pos"] - s["before"] : s["pos"] + least].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], names=[k for k, _ in kinds])

    bodies = texts.mapInArrow(fetch, "anchor bigint, seg bigint, copies bigint, doc_id bigint, body bigint, pos int, before int, h binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict] = []
        size = 0

        def spans() -> pa.RecordBatch:
            segments = [np.frombuffer(r["h"], np.uint32) for r in kept]
            starts = repeated(segments, np.array([r["copies"] for r in kept]), [((r["doc_id"], r["body"]), r["pos"]) for r in kept], np.array([r["before"] for r in kept]), least)
            rows = [(r["anchor"], r["seg"], a - r["before"], b - r["before"]) for r, s in zip(kept, starts) for a, b in merged([(x, x + least) for x in s.tolist()])]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["anchor", "seg", "a", "b"])

        for batch in batches:
            for r in batch.to_pylist():
                if size > MERGED and r["anchor"] != kept[-1]["anchor"]:
                    yield spans()
                    kept, size = [], 0
                kept.append(r)
                size += len(r["h"]) // 4
        if kept:
            yield spans()

    parts = bodies.repartitionById(n, hash_range(F.col("anchor"), n)).sortWithinPartitions("anchor", "seg").mapInArrow(compare, "anchor bigint, seg bigint, a int, b int")
    # a segment that is alone with its copies is repeated as a whole
    alone = segs.where(f"kinds = 1 AND before + after >= {least}").select("anchor", "seg", (-F.col("before")).alias("a"), F.col("after").alias("b"))
    found = again.select("anchor", "seg", "doc_id", "body", "pos").join(parts.union(alone), ["anchor", "seg"])
    found = found.groupBy("doc_id", "body").agg(F.collect_set(F.struct((F.col("pos") + F.col("a")).alias("a"), (F.col("pos") + F.col("b")).alias("b"))).alias("spans"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, a, b) for i, spans in enumerate(batch.column("spans").to_pylist()) for a, b in merged([(s["a"], s["b"]) for s in spans])]
            i, a, b = (np.array([r[k] for r in rows], np.int64) for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(i)), pa.array(a), pa.array(b), pa.array(b - a)], names=["doc_id", "start", "end", "n_words"])

    return found.mapInArrow(join, "doc_id bigint, start bigint, end bigint, n_words bigint")


SQL = rf"""
WITH w AS (
    SELECT doc_id, md5(text) AS k, list_filter(string_split_regex(text, '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)
), places AS (
    SELECT doc_id, k, w, unnest(range(len(w) - {LEAST - 1})) AS i FROM w WHERE len(w) >= {LEAST}
), grams AS (
    SELECT doc_id, k, i, count(*) OVER (PARTITION BY md5(array_to_string(w[i + 1:i + {LEAST}], ' '))) AS n FROM places
), steps AS (
    SELECT doc_id, k, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id, k ORDER BY i) + {LEAST} THEN 0 ELSE 1 END AS step FROM grams WHERE n > 1
), parts AS (
    SELECT doc_id, k, i, sum(step) OVER (PARTITION BY doc_id, k ORDER BY i) AS part FROM steps
)
SELECT doc_id, min(i) AS start, max(i) + {LEAST} AS "end", max(i) + {LEAST} - min(i) AS n_words FROM parts GROUP BY doc_id, k, part
"""
