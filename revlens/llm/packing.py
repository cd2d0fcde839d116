"""Packing documents into windows: repeat counts of length combinations by non-negative least squares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, partitions, sliced, written
from .tokens import TOKENIZER, counter

WINDOW, STEP, DEPTH = 2048, 16, 3


def combinations(units: int, depth: int) -> np.ndarray:
    """Rows: how often each of the lengths 1..units occurs, for all sums of at most depth lengths that give units."""
    found: list[list[int]] = []

    def extend(parts: list[int], left: int, least: int) -> None:
        if left == 0:
            found.append(parts)
        elif len(parts) < depth:
            for x in range(least, left + 1):
                if x == left or (len(parts) + 2 <= depth and left - x >= x):
                    extend([*parts, x], left - x, x)

    extend([], units, 1)
    out = np.zeros((len(found), units), np.int64)
    for i, parts in enumerate(found):
        np.add.at(out[i], np.array(parts) - 1, 1)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 0) -> np.ndarray:
    """x >= 0 with least |ax - b|, by active sets (Lawson and Hanson).

    After `rounds` (6 for each row by default) it stops where it is, not at the least; plan() is complete with any x.
    """
    m, n = a.shape
    x, passive = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(b).max(initial=0)))
    tol = 1e-9 * scale
    w = a.T @ b
    for _ in range(rounds or 6 * m):
        if passive.all() or (best := np.where(passive, -np.inf, w)).max() <= tol:
            break
        passive[int(best.argmax())] = True
        while True:
            s = np.zeros(n)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            bad = passive & (s <= 0)
            if not bad.any():
                break
            alpha = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + alpha * (s - x)
            passive &= x > tol * 1e-3
            x[~passive] = 0
            if not passive.any():
                break
        x = s if passive.any() else np.zeros(n)
        w = a.T @ (b - a @ x)
    return x


def plan(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[np.ndarray, int]]:
    """(combination, repeats): packs a histogram of lengths 1..units completely into windows of that many units.

    The counts that least squares gives are rounded down and cut to what is there; what is left is packed greedily, the
    largest length that fits first, and a window so found is repeated as often as its lengths are there.
    """
    units, left = len(histogram), histogram.astype(np.int64).copy()
    if not left.sum():
        return []
    shapes = combinations(units, depth)
    x = nnls(shapes.T.astype(float), left.astype(float))
    out: list[tuple[np.ndarray, int]] = []

    def take(shape: np.ndarray, most: int) -> None:
        nonlocal left
        used = shape > 0
        n = int(min(most, (left[used] // shape[used]).min()))
        if n > 0:
            left = left - n * shape
            out.append((shape, n))

    for i in np.argsort(-x, kind="stable"):
        if x[i] >= 1:
            take(shapes[i], int(np.floor(x[i] + 1e-6)))
    while left.any():
        shape, room = np.zeros(units, np.int64), units
        for length in range(units, 0, -1):
            if k := int(min(left[length - 1], room // length)):
                shape[length - 1] = k
                room -= k * length
        take(shape, int(left.sum()))
    return out


def pack(docs: DataFrame, window: int = WINDOW, step: int = STEP, depth: int = DEPTH, tokenizer: str = TOKENIZER) -> DataFrame:
    """(bin, slot, doc_id, start, n_tokens): each document's tokens, in pieces of at most a window, each in one bin.

    A document has the tokens of the BPE vocabulary at tokenizer and an end token. It is cut at each multiple of the
    window. Lengths are rounded up to a multiple of step, the unit of the length histogram; see plan(). No bin has more
    than window tokens. Which piece goes where follows from its place among the pieces of its length (by doc_id and start),
    which is counted in two steps and so needs no global sort.

    A null or empty text has no tokens and no row. Repeated rows, and rows with the same doc_id or null in it, are packed
    as documents of their own. An empty table gives an empty result. Other columns are not read.
    """
    if window % step:
        raise ValueError("window must be a multiple of step")
    spark = docs.sparkSession
    n, units = partitions(spark), window // step

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(tokenizer)
        for batch in sliced(batches, "text"):
            lengths = tokens(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.where(lengths > 0, lengths + 1, 0), pa.int64())], names=["doc_id", "n"])

    lengths = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(count), "doc_id bigint, n bigint").where("n > 0")
    pieces = lengths.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(window).cast("bigint"))).alias("start"))
    size = F.least(F.lit(window).cast("bigint"), F.col("n") - F.col("start"))
    pieces = pieces.select("doc_id", "start", size.alias("n_tokens"), F.ceil(size / step).cast("int").alias("unit"), F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("part"))
    pieces = written(pieces, "packing")

    counts = pieces.groupBy("unit", "part").agg(F.count("*").alias("n"))
    histogram = np.zeros(units, np.int64)
    for unit, k in counts.groupBy("unit").agg(F.sum("n")).collect():  # at most window / step rows
        histogram[unit - 1] = k
    chosen = plan(histogram, depth)

    bin_start = np.cumsum([0] + [k for _, k in chosen])
    starts: list[list[int]] = [[] for _ in range(units)]
    shares: list[list[tuple[int, int, int]]] = [[] for _ in range(units)]
    used = np.zeros(units, np.int64)
    for i, (shape, k) in enumerate(chosen):
        slot = 0
        for u in np.flatnonzero(shape)[::-1]:
            starts[u].append(int(used[u]))
            shares[u].append((int(bin_start[i]), int(shape[u]), slot))
            used[u] += k * shape[u]
            slot += int(shape[u])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, nr = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "nr"))
            to, slot = np.zeros(len(unit), np.int64), np.zeros(len(unit), np.int32)
            for u in np.unique(unit):
                at = unit == u
                k = np.searchsorted(starts[u - 1], nr[at], side="right") - 1
                share = np.array(shares[u - 1], np.int64)[k]
                off = nr[at] - np.array(starts[u - 1], np.int64)[k]
                to[at], slot[at] = share[:, 0] + off // share[:, 1], share[:, 2] + off % share[:, 1]
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(slot), *(batch.column(c) for c in ("doc_id", "start", "n_tokens"))], names=["bin", "slot", "doc_id", "start", "n_tokens"])

    before = Window.partitionBy("unit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("unit", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("unit", "part").orderBy("doc_id", "start", "n_tokens")
    placed = pieces.withColumn("nr", F.row_number().over(inside) - 1).join(offsets, ["unit", "part"])
    placed = placed.select("unit", (F.col("nr") + F.col("offset")).cast("bigint").alias("nr"), "doc_id", "start", "n_tokens")
    return placed.mapInArrow(lean(assign), "bin bigint, slot int, doc_id bigint, start bigint, n_tokens bigint")
