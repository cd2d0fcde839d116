"""Chat formatting that is proved by parsing what was rendered."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
MARKER = re.compile(r"<\|im_(?:start|end)\|>")
ROLE_CODES = {"%25": "%", "%0A": "\n", "%3C": "<"}


class Malformed(ValueError):
    pass


def escape(content: str) -> str:
    r"""One backslash more in each "<|", "<\|" and so on; no marker is left."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", content)


def unescape(content: str) -> str:
    return re.sub(r"<\\(\\*\|)", r"<\1", content)


def escape_role(role: str) -> str:
    return role.replace("%", "%25").replace("\n", "%0A").replace("<", "%3C")


def unescape_role(role: str) -> str:
    return re.sub("%25|%0A|%3C", lambda m: ROLE_CODES[m[0]], role)


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"{START}{role}\n{content}{END}\n" for role, content in turns)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation: turn = START role newline content END newline, with no marker inside."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            raise Malformed(f"no turn at {at}")
        head = text.find("\n", at)
        marker = MARKER.search(text, at + len(START))
        if marker is None or marker[0] != END or not at < head < marker.start() or not text.startswith("\n", marker.end()):
            raise Malformed(f"no end of the turn at {at}")
        turns.append((unescape_role(text[at + len(START) : head]), unescape(text[head + 1 : marker.start()])))
        at = marker.end() + 1
    return turns


def _returns(turns: list[tuple[str, str]], source: list[tuple[str, str]]) -> bool:
    try:
        return parse(render(turns)) == source
    except Malformed:
        return False


def format_turns(source: list[tuple[str, str]]) -> tuple[str, int]:
    """The conversation as text that parses to the same turns, and the number of turns with something escaped.

    Only what conflicts is escaped: a turn that doesn't come back by itself has its content escaped, then its role. Escaped
    content holds no marker and unescapes to what it was, so that it always comes back.
    """
    now, escaped = list(source), set()
    for change in (lambda r, c: (r, escape(c)), lambda r, c: (escape_role(r), escape(c))):
        if _returns(now, source):
            break
        for i, turn in enumerate(source):
            if not _returns([now[i]], [turn]):
                now[i] = change(*turn)
                escaped.add(i)
    if not _returns(now, source):
        raise AssertionError("a conversation doesn't come back")
    return render(now), len(escaped)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts, escapes = [], [], []
        for turns in batch.column("turns"):
            source = [(t["role"] or "", t["text"] or "") for t in turns.as_py()]
            text, n = format_turns(source)
            texts.append(text)
            counts.append(len(source))
            escapes.append(n)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(escapes, pa.int32())], names=["conv_id", "text", "n_turns", "n_escaped"])


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, text, n_turns, n_escaped): each conversation rendered, proved to parse to the same turns.

    Turns stand in the order of turn (nulls first), then role and text; repeated rows are turns of their own. Null in role
    or text is "". Rows with null in conv_id make one conversation. An empty table gives an empty result. Other columns are
    not read.
    """
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    whole = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return whole.mapInArrow(_format, "conv_id bigint, text string, n_turns int, n_escaped int")


SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, role, text, coalesce(role, '') AS r, coalesce(text, '') AS c,
           regexp_matches(coalesce(text, ''), '<\|im_(start|end)\|>|<\\+\|') AS content_conflict,
           regexp_matches(coalesce(role, ''), '\n|<\|im_(start|end)\|>|%25|%0A|%3C') AS role_conflict
    FROM conversations
)
SELECT conv_id,
       string_agg('<|im_start|>' || CASE WHEN role_conflict THEN replace(replace(replace(r, '%', '%25'), chr(10), '%0A'), '<', '%3C') ELSE r END || chr(10)
                  || CASE WHEN content_conflict OR role_conflict THEN regexp_replace(c, '<(\\*)\|', '<\\\1|', 'g') ELSE c END || '<|im_end|>' || chr(10),
                  '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text,
       CAST(count(*) AS INTEGER) AS n_turns, CAST(count(*) FILTER (WHERE content_conflict OR role_conflict) AS INTEGER) AS n_escaped
FROM turns GROUP BY conv_id
"""
