"""Line dedup: the first occurrence of each line in the corpus, as a compressed bitmap for each document."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import fresh, hash_range, lean, partitions, released, sliced, written

LINES = "h1 bigint, h2 bigint, doc_id bigint, text_md5 string, pos int, n_lines int"
LINES_ARROW = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("text_md5", pa.string()), ("pos", pa.int32()), ("n_lines", pa.int32())])
#: pos of the row that stands for the document itself.
DOCUMENT = -1
#: n_lines of a line that is kept without comparison.
BLANK = -1


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashed lines; of the copies in one slice only the first, so that no line is hot in the shuffle."""
    for batch in sliced(batches, "text"):
        doc = batch.column("doc_id")
        text = batch.column("text")
        md5 = [None if t is None else hashlib.md5(t.encode()).hexdigest() for t in text.to_pylist()]
        lists = pc.split_pattern(text, "\n")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        row = np.repeat(np.arange(len(sizes)), sizes)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        digests = b"".join(xxhash.xxh3_128_digest(x) for x in flat.to_pylist())
        both = np.frombuffer(digests, dtype=">i8").astype(np.int64).reshape(-1, 2)
        blank = pc.equal(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0).to_numpy(zero_copy_only=False).astype(bool)
        ids = pc.fill_null(doc, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)[row]
        md5_rank = np.unique(np.array([m or "" for m in md5]), return_inverse=True)[1][row] if len(md5) else row
        order = np.lexsort((pos, md5_rank, ids, both[:, 1], both[:, 0]))
        ordered = both[order]
        first = np.ones(len(order), bool)
        first[1:] = (ordered[1:] != ordered[:-1]).any(axis=1) | blank[order][1:]
        keep = np.sort(order[first | blank[order]])
        spread = np.frombuffer(b"".join(xxhash.xxh3_64_digest(f"{d} {m}") for d, m in zip(doc.to_pylist(), md5)), dtype=">i8").astype(np.int64)
        quiet = blank[keep]
        h1 = np.concatenate((np.where(quiet, spread[row[keep]], both[keep, 0]), spread))
        h2 = np.concatenate((np.where(quiet, pos[keep], both[keep, 1]), np.full(len(sizes), DOCUMENT)))
        take = pa.array(np.concatenate((row[keep], np.arange(len(sizes)))))
        at = np.concatenate((pos[keep], np.full(len(sizes), DOCUMENT)))
        n = np.concatenate((np.where(quiet, BLANK, 0), sizes))
        yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), doc.take(take), pa.array(md5, pa.string()).take(take), pa.array(at, pa.int32()), pa.array(n, pa.int32())], schema=LINES_ARROW)


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted rows, the first of each hash; rows of documents and blank lines pass."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, pos, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "pos", "n_lines"))
        first = np.ones(len(h1), bool)
        first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if last is not None:
            first[0] = (h1[0], h2[0]) != last
        last = (h1[-1], h2[-1])
        yield batch.filter(pa.array(first | (pos == DOCUMENT) | (n == BLANK))).select(["doc_id", "text_md5", "pos", "n_lines"])


def runs(kept: np.ndarray, n: int) -> str:
    """A bitmap of n lines as the lengths of its runs, kept and dropped in turn, the first run kept: "3,2,1".

    It starts with "0" if the first line is dropped; no lines: "".
    """
    if not n:
        return ""
    bits = np.zeros(n, bool)
    bits[np.asarray(kept, int)] = True
    edges = np.flatnonzero(bits[1:] != bits[:-1]) + 1
    lengths = np.diff(np.concatenate(([0], edges, [n])))
    return ("" if bits[0] else "0,") + ",".join(map(str, lengths))


def bits(keep: str) -> np.ndarray:
    """The inverse of runs."""
    lengths = [int(x) for x in keep.split(",")] if keep else []
    return np.repeat(np.arange(len(lengths)) % 2 == 0, lengths)


def _bitmaps(docs: DataFrame) -> DataFrame:
    """The rows of line_bitmaps(), and n_rows: how many rows a document has."""
    spark = docs.sparkSession
    n = partitions(spark)
    lines = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(_lines), LINES)
    ordered = lines.repartitionById(n, hash_range(F.col("h1"), n)).sortWithinPartitions("h1", "h2", "doc_id", "text_md5", "pos")
    firsts = ordered.mapInArrow(lean(_firsts), "doc_id bigint, text_md5 string, pos int, n_lines int")

    @F.pandas_udf(StringType())
    def encode(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for kept, n in batches:
            yield pd.Series([runs(k, int(m)) for k, m in zip(kept, n)], dtype=object)
        kept = n = None
        released()

    line = F.col("pos") != DOCUMENT
    by_doc = firsts.groupBy("doc_id", "text_md5").agg(F.collect_set(F.when(line, F.col("pos"))).alias("kept"), F.max(F.when(~line, F.col("n_lines"))).alias("n_lines"), F.count_if(~line).alias("n_rows"))
    return by_doc.select("doc_id", "text_md5", "n_lines", F.size("kept").alias("n_kept"), encode("kept", "n_lines").alias("keep"), "n_rows")


def line_bitmaps(docs: DataFrame) -> DataFrame:
    """(doc_id, text_md5, n_lines, n_kept, keep): which lines of each document occur for the first time.

    Lines are what "\\n" separates, compared byte by byte through 128-bit hashes, in the order of doc_id (nulls first),
    MD5 of the text and position. Blank lines, of ASCII white space alone (blank, \\t, \\v, \\f, \\r) or nothing, are always
    kept. keep: see runs(). Long texts are taken whole.

    Rows with the same doc_id and text are one document; other rows with a doc_id in common, or null in doc_id, are
    documents of their own. A null text has no line (n_lines 0, keep "", text_md5 null); an empty text has one blank line.
    An empty table gives an empty result. Other columns are not read, whatever their names.

    The hashes are range-partitioned (ranges of equal width, as hashes are uniform: no sampling pass) and sorted within a
    range by hash, document and position; one pass then streams first occurrences. The text itself is never shuffled.
    """
    return _bitmaps(docs).drop("n_rows")


@F.pandas_udf(StringType())
def _apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, keep in batches:
        yield pd.Series([None if t is None else "\n".join(x for x, b in zip(t.split("\n"), bits(k)) if b) for t, k in zip(text, keep)], dtype=object)
    text = keep = None
    released()


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents with only the lines that line_bitmaps() keeps, n_chars following; all columns stay.

    Rows with the same doc_id and text become one (any of them, if other columns differ). Documents that lose lines and
    have none left but blank ones go; documents that were blank or null before stay as they are. Nulls, ties and long
    texts: see line_bitmaps(). An empty table gives an empty result; names of other columns don't matter.

    Only what changes is joined to the documents: by one key, so that texts are shuffled once at most, and not at all
    where few documents change.
    """
    key, n_lines, n_kept, n_rows, keep = (fresh(docs, "line_" + c) for c in ("key", "n_lines", "n_kept", "n_rows", "keep"))

    def key_of(doc_id: Column, md5: Column) -> Column:
        return F.concat_ws("|", F.coalesce(doc_id.cast("bigint").cast("string"), F.lit("null")), F.coalesce(md5, F.lit("null"))).alias(key)

    maps = _bitmaps(docs).where("n_kept < n_lines OR n_rows > 1")
    maps = maps.select(key_of(F.col("doc_id"), F.col("text_md5")), F.col("n_lines").alias(n_lines), F.col("n_kept").alias(n_kept), F.col("n_rows").alias(n_rows), F.col("keep").alias(keep))
    maps = written(maps, "lines")  # so that its size is known to the optimizer
    joined = docs.select("*", key_of(F.col("doc_id"), F.md5(F.col("text").cast("string")))).join(maps, key, "left")
    several = F.coalesce(F.col(n_rows), F.lit(1)) > 1
    one = joined.where(~several).unionByName(joined.where(several).dropDuplicates([key]))
    short = F.coalesce(F.col(n_kept) < F.col(n_lines), F.lit(False))
    text = F.when(short, _apply(F.when(short, F.col("text")), F.col(keep))).otherwise(F.col("text"))
    out = one.withColumn("text", text).where(~short | F.rlike("text", F.lit(r"[^ \t\n\r\f\x0B]")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(short, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


SQL = """
WITH lines AS (
    SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
    FROM (SELECT DISTINCT doc_id, text FROM documents)
), ranked AS (
    SELECT doc_id, text, pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) = '' OR row_number() OVER (PARTITION BY line ORDER BY doc_id NULLS FIRST, md5(text), pos) = 1 AS kept
    FROM lines
), changes AS (
    SELECT *, pos - row_number() OVER (PARTITION BY doc_id, text, kept ORDER BY pos) AS island FROM ranked
), runs AS (
    SELECT doc_id, text, kept, min(pos) AS first_pos, count(*) AS n FROM changes GROUP BY doc_id, text, kept, island
)
SELECT doc_id, md5(text) AS text_md5, CAST(sum(n) AS INTEGER) AS n_lines, CAST(coalesce(sum(n) FILTER (WHERE kept), 0) AS INTEGER) AS n_kept,
       CASE WHEN arg_min(kept, first_pos) THEN '' ELSE '0,' END || string_agg(CAST(n AS VARCHAR), ',' ORDER BY first_pos) AS keep
FROM runs GROUP BY doc_id, text
UNION ALL
SELECT DISTINCT doc_id, NULL, 0, 0, '' FROM documents WHERE text IS NULL
"""
