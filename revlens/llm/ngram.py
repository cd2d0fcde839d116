"""An interpolated modified Kneser-Ney language model: counted in Spark, kept as sorted hash arrays, mapped by workers."""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh_dir, lean, local_path, mix, partitions, shuffles_released, sliced, word_hashes, words, written

#: Words of the longest grams: one to predict, and its context.
ORDER = 3
#: Bytes of text whose grams a worker counts before they are sent, and scores at once.
COUNTED, SCORED = 36 << 20, 6 << 20
FIRST, FINAL = "\x00<s>", "\x00</s>"
#: Stands in a gram for what would be before a text's beginning.
NONE = word_hashes(["\x00"]) >> np.uint64(16)


def _hashes(vocabulary: list[str]) -> np.ndarray:
    """48-bit hashes of the words, then those of a text's beginning and end."""
    return word_hashes([*vocabulary, FIRST, FINAL]) >> np.uint64(16)


def _range(key: np.ndarray, n: int) -> np.ndarray:
    """The range, of n of equal width, of a 64-bit key."""
    return ((key >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def _keys(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of grams (a column of 48-bit hashes for each of their words): what routes them, and their own.

    Grams go by their context, the words before the last, so that a context's continuations meet; words go by themselves.
    """
    context = key = columns[0] << np.uint64(16)
    for w in columns[1:]:
        context, key = key, mix(key * np.uint64(0x9E3779B97F4A7C15) + mix(w))
    return context, key


def _grams(codes: np.ndarray, offsets: np.ndarray, size: int, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Codes (a column for each word) and texts of all grams, one for each word and end.

    A beginning has code size, an end size + 1, what would be before a beginning size + 2; a text without words has no gram.
    """
    n = np.diff(offsets)
    some = n > 0
    right = np.insert(codes, offsets[1:][some], size + 1)
    lengths = n[some] + 1
    within = np.arange(len(right)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    columns = [right]
    for back in range(1, order):
        left = np.full(len(right), size + 2, right.dtype)
        left[back:] = right[: max(0, len(right) - back)]
        left[within == back - 1] = size
        left[within < back - 1] = size + 2
        columns.insert(0, left)
    return columns, np.repeat(np.arange(len(n)), np.where(some, n + 1, 0))


def _joined(columns: list[np.ndarray], size: int) -> np.ndarray:
    """One integer for each gram of codes below size, in the grams' order where the codes of all columns fit into it."""
    bits = max(1, int(size).bit_length())
    if bits * len(columns) > 63:
        return _keys([c.astype(np.uint64) for c in columns])[1]
    out = columns[0].astype(np.uint64)
    for c in columns[1:]:
        out = out << np.uint64(bits) | c.astype(np.uint64)
    return out


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A place of each distinct key in order, how often it is there, and the order."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(keys))), order


def _planes(x: np.ndarray, item: int) -> bytes:
    """The numbers of each row byte by byte, the lowest bytes of all first: what compresses well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(*x.shape, 8)[..., :item].swapaxes(-1, -2)).tobytes()


def _from_planes(x: bytes, at: int, rows: int, n: int, item: int) -> np.ndarray:
    out = np.zeros((rows, n, 8), np.uint8)
    out[..., :item] = np.frombuffer(x, np.uint8, rows * item * n, at).reshape(rows, item, n).swapaxes(1, 2)
    return out.view("<u8")[..., 0]


def _packed(columns: list[np.ndarray], hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Grams of codes into hashes: the 48-bit hashes that occur, places in them, sorted by the first words, and counts.

    Hashes are in classes (how often they occur, by powers of two; often ones first), in order in each. They and the first
    column are kept as differences.
    """
    often = np.bincount(np.concatenate(columns), minlength=len(hashes))
    there = np.flatnonzero(often)
    level = np.frexp(often[there])[1]
    order = np.lexsort((hashes[there], -level))
    there = there[order]
    place = np.zeros(len(hashes), np.int64)
    place[there] = np.arange(len(there))
    columns = [place[c] for c in columns]
    order = np.argsort(_joined(columns, len(there)), kind="stable") if len(there).bit_length() * len(columns) < 64 else np.lexsort(columns[::-1])
    columns, counts, h = [c[order] for c in columns], counts[order], hashes[there]
    columns[0] = np.diff(columns[0], prepend=0)
    item = 2 if len(h) <= 1 << 16 else 4
    large = np.flatnonzero(counts > 254)
    sizes = np.array([len(columns), len(counts), len(h), len(large), item], np.int64)
    gaps = np.diff(h, prepend=np.uint64(0)) & np.uint64((1 << 48) - 1)  # modulo 2**48 where a class begins
    parts = (_planes(gaps[None], 6), _planes(np.stack(columns), item), np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[large].astype(np.int64).tobytes())
    return sizes.tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpacked(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A row of hashes for each word of the grams, and the counts."""
    width, n, k, large, item = np.frombuffer(x, np.int64, 5).tolist()
    rest = zstandard.ZstdDecompressor().decompress(x[40:])
    h = np.cumsum(_from_planes(rest, 0, 1, k, 6)[0], dtype=np.uint64) & np.uint64((1 << 48) - 1)
    place = _from_planes(rest, 6 * k, width, n, item).astype(np.int64)
    place[0] = np.cumsum(place[0])
    at = 6 * k + width * item * n
    counts = np.frombuffer(rest, np.uint8, n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(rest, np.int64, large, at + n)
    return h[place], counts


def _blocks(columns: list[np.ndarray], hashes: np.ndarray, counts: np.ndarray, to: np.ndarray, n: int) -> Iterator[tuple[int, bytes]]:
    """The packed grams of each range that there are some of."""
    order = np.argsort(to, kind="stable")
    edges = np.searchsorted(to[order], np.arange(n + 1))
    for i in np.flatnonzero(np.diff(edges)).tolist():
        at = order[edges[i] : edges[i + 1]]
        yield i, _packed([c[at] for c in columns], hashes, counts[at])


def _stored(folder: str, name: str, keys: np.ndarray, codes: np.ndarray, rows: np.ndarray) -> None:
    """A sorted hash array: of each key, its leading bits as a place in an index, and the 24 bits after them; a byte of value.

    Of n keys in a file, about log2(n) + 21 bits tell them apart: one in four million keys has another's value.
    Where the byte is 255, the value is a row of rows. The file is there whole or not at all, whichever attempt of a task
    writes it.
    """
    bits = min(24, max(1, len(keys).bit_length() - 3))
    index = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    large, rest = np.flatnonzero(codes == 255), keys << np.uint64(bits) >> np.uint64(40)
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        for x in (np.array([len(keys), bits, len(large), rows.shape[1]], np.int64), large.astype(np.int64), rows.astype(np.int64), index.astype(np.uint32), (rest & np.uint64(0xFFFF)).astype(np.uint16), codes.astype(np.uint8), (rest >> np.uint64(16)).astype(np.uint8)):
            f.write(x.tobytes())
    os.replace(part, f"{folder}/{name}")


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the sums of their counts, and a place of each."""
    starts, _, order = _distinct(keys)
    return keys[order[starts]], np.add.reduceat(counts[order], starts) if len(keys) else counts, order[starts]


def _of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def _context_codes(of: np.ndarray) -> np.ndarray:
    """A byte for a context's total and its numbers of continuations with counts 1, 2 and more; 255 where it takes a row."""
    return np.where((of[:, 3] == 0) & (of[:, 1] <= 15) & (of[:, 2] <= 14), of[:, 1] + 16 * of[:, 2], 255)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The discounts of counts 1, 2 and from 3 on; half of each where a count of counts is 0."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


class Model:
    """The arrays of a model, mapped when they are first asked for."""

    def __init__(self, folder: str, n: int, levels: list[list[int]]):
        """levels: for grams of one word, two and so on, how many have the count 1, 2, 3 and 4, and how many there are."""
        self.folder, self.n, self.levels = folder, n, levels
        self.discounts = [np.array([0.0, *discounts(*x[:4])]) for x in levels]
        (m1, m2, _, _, kinds), d = levels[0], self.discounts[0].tolist()
        self.types = max(levels[1][4], 1)  # distinct bigrams
        self.floor = (d[1] * m1 + d[2] * m2 + d[3] * (kinds - m1 - m2)) / self.types / (kinds + 1) if kinds else 1.0
        self.array = functools.cache(self._array)

    def _array(self, name: str) -> tuple[np.ndarray, ...] | None:
        path = Path(self.folder, name)
        if not path.exists():  # no gram is in this range
            return None
        x = np.memmap(path, np.uint8, "r")
        n, bits, large, width = x[:32].view(np.int64).tolist()
        ends = np.cumsum([32, 8 * large, 8 * large * width, 4 * ((1 << bits) + 1), 2 * n, n, n])
        places, rows, index, low, codes, high = (x[a:b] for a, b in zip(ends, ends[1:]))
        return places.view(np.int64), rows.view(np.int64).reshape(-1, width), index.view(np.uint32), low.view(np.uint16), high, codes, bits

    def find(self, what: str, ranges: np.ndarray, keys: np.ndarray, width: int = 1) -> np.ndarray:
        """The values of keys, 0 where there is none: of grams their counts, of contexts (width 4) see _context_codes()."""
        out = np.zeros((len(keys), width), np.float64)
        bits = np.uint64(self.n.bit_length())
        order = np.argsort(ranges.astype(np.uint64) << (np.uint64(64) - bits) | keys >> bits)  # about in order of keys, in each range
        edges = np.searchsorted(ranges[order], np.arange(self.n + 1))
        for i in np.flatnonzero(np.diff(edges)):
            if (stored := self.array(f"{what}-{i}")) is None:
                continue
            places, rows, index, low_bits, high_bits, codes, bits = stored
            mine = order[edges[i] : edges[i + 1]]
            lead, want = (keys[mine] >> np.uint64(64 - bits)).astype(np.int64), (keys[mine] << np.uint64(bits) >> np.uint64(40)).astype(np.int64)

            def rest(at: np.ndarray) -> np.ndarray:
                return high_bits[at].astype(np.int64) << 16 | low_bits[at]  # noqa: B023

            low, end = index[lead].astype(np.int64), index[lead + 1].astype(np.int64)
            high = end.copy()
            while (left := low < high).any():
                middle = (low + high) >> 1
                less = left & (rest(np.minimum(middle, len(codes) - 1)) < want)
                low, high = np.where(less, middle + 1, low), np.where(left & ~less, middle, high)
            hit = low < end
            hit[hit] = rest(low[hit]) == want[hit]
            mine, at = mine[hit], low[hit]
            code = codes[at].astype(np.int64)
            found = code[:, None] if width == 1 else np.stack(((code & 15) + 2 * (code >> 4), code & 15, code >> 4, np.zeros_like(code)), axis=1)
            big = np.flatnonzero(code == 255)
            found[big] = rows[np.searchsorted(places, at[big])]
            out[mine] = found
        return out

    def logs(self, *columns: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of the last column's words after those before it (48-bit hashes).

        Contexts that are not in the model, or not whole (NONE), leave what the shorter ones say.
        """
        words_, same = np.unique(columns[-1], return_inverse=True)
        key = _keys([words_])[1]
        a, d = self.find("gram1", _range(key, self.n), key)[:, 0], self.discounts[0]
        p = (np.maximum(a - d[np.minimum(a, 3).astype(int)], 0) / self.types + self.floor)[same]
        for k in range(2, len(columns) + 1):
            context, key = _keys(columns[-k:])
            d = self.discounts[k - 1]
            c = self.find(f"gram{k}", _range(context, self.n), key)[:, 0]
            contexts, same = np.unique(context, return_inverse=True)
            of = self.find(f"context{k}", _range(contexts, self.n), contexts, 4)
            if k > 2 and len(lone := np.flatnonzero(of[:, 0] == 0)):  # it has one continuation, which occurs once, if it is there
                before = np.zeros(len(contexts), np.int64)
                before[same] = np.arange(len(same))
                there = np.bincount(same, c, len(contexts))[lone] > 0
                unsure = lone[~there]
                shorter, own = _keys([x[before[unsure]] for x in columns[-k:-1]])
                there[~there] = self.find(f"gram{k - 1}", _range(shorter, self.n), own)[:, 0] > 0
                of[lone[there]] = (1, 1, 0, 0)
            total = of[:, 0]
            spare = np.where(total > 0, (of[:, 1:] @ d[1:]) / np.maximum(total, 1), 1.0)[same]
            p = np.maximum(c - d[np.minimum(c, 3).astype(int)], 0) / np.maximum(total, 1)[same] + spare * p
        return np.log(p)


def fit(docs: DataFrame, order: int = ORDER) -> Model:
    """Counts all grams of order words of the texts, and stores the model in the shared folder (which must be mounted).

    Grams are counted in slices, sent in blocks to ranges of their contexts' hashes, and merged there: counts, the contexts'
    totals and numbers of continuations with counts 1, 2 and more. From there the grams without their first words go to
    ranges of their own, with the number of different words before them, and so on down to single words; grams at a
    text's beginning, which nothing is before, keep their counts. Only counts of counts come to the driver. Between levels
    the blocks are written, so that a level's shuffle files are deleted before those of the next are there.
    """
    if order < 2:
        raise ValueError("order must be 2 at least")
    spark = docs.sparkSession
    n, uri = partitions(spark), fresh_dir(spark, "ngram")
    folder = local_path(uri)
    os.makedirs(folder)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", COUNTED):
            vocabulary, codes, offsets = words(batch.column("text"))
            h = np.concatenate((_hashes(vocabulary), NONE))
            columns = _grams(codes.astype(np.int32), offsets, len(vocabulary), order)[0]
            starts, counts, at = _distinct(_joined(columns, len(h)))
            columns = [c[at[starts]] for c in columns]
            for i, b in _blocks(columns, h, counts, _range(_keys([h[c] for c in columns])[0], n), n):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([b], pa.binary()), pa.array([None], pa.list_(pa.int64()))], names=["part", "b", "n"])

    def merge(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stores the grams of k words, and sends on those of one word less; rows with counts of counts (after k) pass."""
        parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for i, b, of in zip(*(batch.column(c).to_pylist() for c in ("part", "b", "n"))):
                if of:
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([None], pa.binary()), pa.array([of], pa.list_(pa.int64()))], names=["part", "b", "n"])
                else:
                    parts.setdefault(i, []).append(_unpacked(b))
        for i in list(parts):
            columns, counts = (np.concatenate(x, axis=-1) for x in zip(*parts.pop(i)))
            key, counts, at = _merged(_keys(list(columns))[1], counts)
            columns = columns[:, at]
            context = _keys(list(columns))[0]
            whole = columns[0] != NONE[0]
            own = counts[whole]
            _stored(folder, f"gram{k}-{i}", key[whole], np.minimum(own, 255), own[own >= 255][:, None])
            if k > 1:
                contexts, same = np.unique(context[whole], return_inverse=True)
                of = np.stack([np.bincount(same, own, len(contexts)), *(np.bincount(same[sel], minlength=len(contexts)) for sel in (own == 1, own == 2, own > 2))], axis=1).astype(np.int64)
                code = _context_codes(of)
                if k > 2:  # not those that the shorter grams imply, see Model.logs()
                    some = code != 1
                    contexts, code, of = contexts[some], code[some], of[some]
                _stored(folder, f"context{k}-{i}", contexts, code, of[code == 255])
            sent = [(i, None, [k, *_of_counts(own), len(own)])]
            if k > 1:
                h, rest = np.unique(columns[1:], return_inverse=True)
                rest = list(rest.reshape(k - 1, -1))
                counts = np.where(whole, 1, counts)
                starts, _, at = _distinct(_joined(rest, len(h)))
                counts = np.add.reduceat(counts[at], starts)
                rest = [c[at[starts]] for c in rest]
                sent += [(j, b, None) for j, b in _blocks(rest, h, counts, _range(_keys([h[c] for c in rest])[0], n), n)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*sent), (pa.int32(), pa.binary(), pa.list_(pa.int64())))], names=["part", "b", "n"])

    kinds = "part int, b binary, n array<bigint>"
    blocks = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(count), kinds)
    for k in range(order, 0, -1):
        sent = blocks
        blocks = sent.repartitionById(n, F.col("part")).mapInArrow(lean(functools.partial(merge, k)), kinds)
        if k > 1:  # what was sent is not on disk any more while the next level is merged
            blocks = written(blocks, "ngram-blocks")
            discard(sent)
            shuffles_released(spark)
    levels = {k: [0] * 5 for k in range(1, order + 1)}
    for row in blocks.where("n IS NOT NULL").groupBy(F.col("n")[0].alias("k")).agg(*(F.sum(F.col("n")[i]) for i in range(1, 6))).collect():
        levels[row[0]] = list(row[1:])
    discard(sent)
    return Model(folder, n, list(levels.values()))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_words, log_probability, perplexity) of each row under a model of fit()."""
    what = (model.folder, model.n, model.levels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*what)
        for batch in sliced(batches, "text", SCORED):
            vocabulary, codes, offsets = words(batch.column("text"))
            h = np.concatenate((_hashes(vocabulary), NONE))
            columns, doc = _grams(codes, offsets, len(vocabulary), len(m.levels))
            starts, counts, at = _distinct(_joined(columns, len(h)))
            logs = np.zeros(len(at))
            if len(at):
                logs[at] = np.repeat(m.logs(*(h[c[at[starts]]] for c in columns)), counts)
            n = np.diff(offsets)
            total = np.bincount(doc, logs, len(n))
            none = n == 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(np.round(total, 4), mask=none), pa.array(np.round(np.exp(-total / (n + 1)), 2), mask=none)], names=["doc_id", "n_words", "log_probability", "perplexity"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(score), "doc_id bigint, n_words bigint, log_probability double, perplexity double")


def perplexities(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, log_probability, perplexity): each row's text under the model, of this order, of all rows' texts.

    Words are what ASCII white space separates; a text has a beginning, which is only a context, and an end. Probabilities
    are interpolated, with modified Kneser-Ney discounts of each order (see discounts()), and the unigrams' spare mass
    spread evenly over the words and one unknown. Logarithms are natural and rounded to 4 places, perplexity to 2.

    Null and empty texts add nothing to the model and have null scores. Repeated rows count, and are scored, each time; so
    do rows without doc_id. An empty table gives an empty result. Other columns are not read.
    """
    return scored(docs, fit(docs, order))


def _discount(k: int, n: str) -> str:
    return f"CASE WHEN {n}1 * {n}2 * {n}3 * {n}4 = 0 THEN {k / 2} ELSE least(greatest({k} - {k + 1} * ({n}1 / ({n}1 + 2 * {n}2)) * {n}{k + 1} / {n}{k}, 0), {k}) END"


def _sql_level(k: int, context: str, lower: str) -> str:
    """d: discounts of level k; x: the contexts' sums; p: probabilities."""
    n = ", ".join(f"CAST(count(*) FILTER (WHERE n = {i}) AS DOUBLE) AS n{i}" for i in (1, 2, 3, 4))
    return f"""n{k} AS (SELECT {n}, count(*) AS kinds FROM g{k}),
d{k} AS (SELECT {', '.join(f'{_discount(i, "n")} AS d{i}' for i in (1, 2, 3))}, kinds, n1, n2 FROM n{k}),
""" + (f"""x{k} AS (SELECT {context}, sum(n) AS total, count(*) FILTER (WHERE n = 1) AS k1, count(*) FILTER (WHERE n = 2) AS k2, count(*) FILTER (WHERE n > 2) AS k3 FROM g{k} GROUP BY {context}),
p{k} AS (SELECT {context}, c, greatest(n - CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END, 0) / total + (d1 * k1 + d2 * k2 + d3 * k3) / total * p AS p FROM g{k} JOIN x{k} USING ({context}) JOIN {lower}, d{k})""" if context else "")


#: Of order 3.
SQL = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS w FROM documents
), long AS (
    SELECT r, list_concat([NULL, chr(1) || '<s>'], w, [chr(1) || '</s>']) AS w FROM docs WHERE len(w) > 0
), tokens AS (
    SELECT r, unnest(w[1:len(w) - 2]) AS a, unnest(w[2:len(w) - 1]) AS b, unnest(w[3:]) AS c FROM long
), g3 AS (
    SELECT a, b, c, count(*) AS n FROM tokens WHERE a IS NOT NULL GROUP BY ALL
), g2 AS (
    SELECT b, c, count(*) AS n FROM g3 GROUP BY ALL UNION ALL SELECT b, c, count(*) FROM tokens WHERE a IS NULL GROUP BY ALL
), g1 AS (
    SELECT c, count(*) AS n FROM g2 GROUP BY c
), {_sql_level(1, "", "")}
p1 AS (
    SELECT c, greatest(n - CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END, 0) / types + (d1 * n1 + d2 * n2 + d3 * (kinds - n1 - n2)) / types / (kinds + 1) AS p
    FROM g1, d1, (SELECT count(*) AS types FROM g2)
), {_sql_level(2, "b", "p1 USING (c)")}, {_sql_level(3, "a, b", "p2 USING (b, c)")},
sums AS (
    SELECT r, sum(ln(coalesce(p3.p, p2.p))) AS p FROM tokens LEFT JOIN p3 USING (a, b, c) JOIN p2 USING (b, c) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, round(p, 4) AS log_probability, round(exp(-p / (len(w) + 1)), 2) AS perplexity FROM docs LEFT JOIN sums USING (r)
"""
