"""Exact token counts of byte-level BPE, at the cost of the distinct words of a slice."""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space other than single blanks and line feeds between words, where pieces could span a blank.
UNEVEN = r"[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z"
#: Words whose counts a worker remembers.
REMEMBERED = 400_000


def counter(path: str) -> Callable[[pa.Array], np.ndarray]:
    """Token counts of texts under the vocabulary at path (tiktoken's format); null counts 0.

    The pattern never joins a blank to what stands before it, so that a text with single blanks falls apart into its
    blank-separated pieces, each with its blank in front; each distinct piece is encoded once. Other texts are encoded
    whole.
    """
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    known: dict[str, int] = {}

    def count(text: pa.Array) -> np.ndarray:
        text = pc.fill_null(text, "")
        lists = pc.split_pattern(text, " ")
        encoded = pc.dictionary_encode(lists.flatten())
        codes = encoded.indices.to_numpy(zero_copy_only=False)
        if len(known) > REMEMBERED:
            known.clear()
        size = np.empty(len(encoded.dictionary), np.int64)
        for i, w in enumerate(encoded.dictionary.to_pylist()):
            n = known.get(w)
            if n is None:
                n = known[w] = len(encoding.encode_ordinary(" " + w))
            size[i] = n
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        sums = np.concatenate(([0], np.cumsum(size[codes])))
        out = sums[offsets[1:]] - sums[offsets[:-1]]
        heads = encoded.dictionary.take(encoded.indices.take(pa.array(np.minimum(offsets[:-1], max(0, len(codes) - 1))))).to_pylist() if len(codes) else []
        uneven = pc.match_substring_regex(text, UNEVEN).to_numpy(zero_copy_only=False)
        whole = text.to_pylist() if uneven.any() else None
        for i, head in enumerate(heads):
            out[i] = len(encoding.encode_ordinary(whole[i])) if uneven[i] else out[i] - known[head] + len(encoding.encode_ordinary(head))
        return out

    return count
