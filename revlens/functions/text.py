"""String functions, each from columns to a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unescape_xml(c: Column) -> Column:
    """The four named entities decoded, the ampersand last, so that "&amp;lt;" gives "&lt;"; other entities stay."""
    for code, char in (("&gt;", ">"), ("&lt;", "<"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(code), F.lit(char))
    return c


def escape_xml(c: Column) -> Column:
    for code, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        c = F.replace(c, F.lit(char), F.lit(code))
    return c


def element_value(line: Column) -> Column:
    """What is between the first ">" and the last "</" of a line; "" if there is no such part."""
    return F.regexp_extract(line, r"^[^>]*>(.*)</", 1)


def element_value_multiline(lines: Column) -> Column:
    """As element_value over line ends; null for an element that closes itself."""
    return F.when(F.rtrim(lines).endswith("/>") & ~F.contains(lines, F.lit("</")), F.lit(None)).otherwise(F.regexp_extract(lines, r"(?s)^[^>]*>(.*)</", 1))


def is_opening_tag(line: Column, element: str) -> Column:
    """A prefix test: the tag "<id" is also found in "<idx"."""
    return F.ltrim(line).startswith("<" + element)


def is_closing_tag(line: Column, element: str) -> Column:
    return F.rtrim(line).endswith(f"</{element}>")


def attribute(line: Column, name: str) -> Column:
    return F.regexp_extract(line, rf'{name}="([^"]*)"', 1)


def kebab_case(c: Column) -> Column:
    return F.ltrim(F.lower(F.regexp_replace(c, "([A-Z])", "-$1")), F.lit("-"))


def bin_label(low: Column, high: Column) -> Column:
    """Of whole numbers low to high (exclusive; null: open): "a", "a--b" or "≥a"."""
    return F.when(high.isNull(), F.concat(F.lit("≥"), low.cast("string"))).when(high == low + 1, low.cast("string")).otherwise(F.concat(low.cast("string"), F.lit("--"), (high - 1).cast("string")))


def interval_label(low: Column, high: Column) -> Column:
    """Of an interval that holds its upper end (null: open): "[0,b]", "(a,b]" or "(a,∞)"."""
    start = F.when(low.isNull(), F.lit("[0")).otherwise(F.concat(F.lit("("), low.cast("string")))
    return F.concat(start, F.lit(","), F.coalesce(F.concat(high.cast("string"), F.lit("]")), F.lit("∞)")))


def scientific(c: Column) -> Column:
    """One decimal and a power of ten: 12345 is "1.2·10^4"."""
    parts = F.split(F.format_string("%.1e", c.cast("double")), "e")
    return F.concat(parts[0], F.lit("·10^"), parts[1].cast("int").cast("string"))


def percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def file_range(path: Column, kind: str = "p") -> Column:
    """The numbers of a name such as "...-p10-p20.7z", as struct<low, high>."""
    found = [F.regexp_extract(path, rf"-{kind}(\d+)-{kind}(\d+)\.[^/]*$", i).cast("bigint") for i in (1, 2)]
    return F.struct(found[0].alias("low"), found[1].alias("high"))


def file_name(prefix: str, kind: str, low: Column, high: Column, suffix: str = ".7z") -> Column:
    return F.format_string(f"{prefix}-{kind}%d-{kind}%d{suffix}", low, high)


def day_file(path: Column) -> Column:
    """The day (or month) and revision ids in a name such as "d20210601-r5-r9.jsonl", as struct<date, low, high>."""
    pattern = r"d(\d{6,8})-r(\d+)-r(\d+)\."
    return F.struct(F.regexp_extract(path, pattern, 1).alias("date"), *[F.regexp_extract(path, pattern, i).cast("bigint").alias(n) for i, n in ((2, "low"), (3, "high"))])


def artifact(group: Column, name: Column, version: Column) -> Column:
    return F.concat_ws(":", group, name, version)
