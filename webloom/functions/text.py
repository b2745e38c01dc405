"""Markdown, YAML and plain-text column functions; each takes and returns Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import let

# Unicode White_Space as a Java character class, without and with the line feed.
WSN = r"[\t\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WS = r"[\n" + WSN[1:]
# What marks a query as Japanese (Hiragana, Katakana, two ranges of ideographs).
JAPANESE = r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]"
# What a language choice appends to a query.
LANGUAGE_SUFFIX = {"ja": " (日本語で回答)", "en": " (answer in English)"}


def trim(s: Column) -> Column:
    return F.regexp_replace(s, rf"\A{WS}+|{WS}+\z", "")


def escape_md_link(s: Column) -> Column:
    r"""A backslash before each of [ ] ( )."""
    return F.regexp_replace(s, r"([\[\]()])", r"\\$1")


def sanitize_heading(s: Column) -> Column:
    """Line ends become spaces, one each."""
    return F.translate(s, "\n\r", "  ")


def escape_yaml(s: Column) -> Column:
    """For a double-quoted YAML scalar; NUL is dropped."""
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\0", "")):
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def truncate_with_note(s: Column, most: int, total: Column | None = None) -> Column:
    """At most `most` UTF-8 bytes, cut at a character, and a note if anything was cut. With `total`, s is what is at hand of a text
    of so many bytes, all of it or more than `most`."""
    total = F.octet_length(s) if total is None else total
    raw = s.cast("binary")
    heads = [F.try_validate_utf8(F.substring(raw, 1, most - k).cast("string")) for k in range(min(4, most + 1))]
    head = F.coalesce(*heads, F.lit(""))
    note = F.concat(F.lit("\n\n(truncated: showing "), F.octet_length(head).cast("string"), F.lit(" / "), total.cast("string"), F.lit(" bytes)"))
    return F.when(total <= most, s).otherwise(F.concat(head, note))


def lines(s: Column) -> Column:
    """Lines without their ends: LF or CR LF, none after a final line end; an empty text has no lines."""
    body = F.regexp_replace(s, r"\r?\n\z", "")
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n", -1))


def shift_headings(md: Column, levels: int) -> Column:
    """`levels` more # before every line that begins with #, but for lines in code fences."""
    if levels == 0:
        return md
    text = F.concat(F.lit("\n"), F.regexp_replace(F.replace(md, F.lit("\r\n"), F.lit("\n")), r"\n\z", ""))
    parts = F.split(text, rf"(?md)^(?={WSN}*(?:```|~~~))", -1)
    # odd parts begin with an opening fence and end before the closing one
    shifted = F.transform(parts, lambda x, i: F.when(i % 2 == 0, F.regexp_replace(x, rf"(?md)^({WSN}*)#", "$1" + "#" * (levels + 1))).otherwise(x))
    return F.substring(F.array_join(shifted, ""), 2, 2**31 - 1)


def apply_language(query: Column, lang: Column) -> Column:
    out = query
    for code, suffix in LANGUAGE_SUFFIX.items():
        out = F.when(lang == code, F.concat(query, F.lit(suffix))).otherwise(out)
    return out


def contains_japanese(s: Column) -> Column:
    return s.rlike(JAPANESE)


def ascii_query(s: Column) -> Column:
    """The query's ASCII terms of two characters or more; the query itself if it has none."""
    terms = F.filter(F.split(s, r"[^A-Za-z0-9._-]", -1), lambda w: F.octet_length(w) >= 2)
    return F.when(F.size(terms) == 0, s).otherwise(F.array_join(terms, " "))


def expand_bilingual(query: Column) -> Column:
    """An array of the query and, for a Japanese one, its ASCII form where that differs."""
    english = ascii_query(query)
    return F.when(contains_japanese(query) & (english != query), F.array(query, english)).otherwise(F.array(query))


def format_size(n: Column, largest: str = "MB") -> Column:
    """Bytes as B, KB or MB; with `largest` KB, no size is MB."""
    kb = lambda x: F.format_string("%.1f", F.bround(x, 1))
    small = F.concat(n.cast("string"), F.lit(" B"))
    in_kb = F.concat(kb(n / F.lit(1024.0)), F.lit(" KB"))
    if largest == "KB":
        return F.when(n < 1024, small).otherwise(in_kb)
    return F.when(n < 1024, small).when(n < 1024 * 1024, in_kb).otherwise(F.concat(kb(n / F.lit(1048576.0)), F.lit(" MB")))


def parse_line_range(s: Column) -> Column:
    """struct(start, end) of 'a-b', 'a-' (end null) or 'n' (1 to n); null if it is none of these."""
    t = trim(s)
    number = lambda x: F.when(trim(x).rlike(r"\A\+?[0-9]+\z"), trim(x).try_cast("bigint"))
    first, rest = F.regexp_extract(t, r"(?s)\A([^-]*)-(.*)\z", 1), F.regexp_extract(t, r"(?s)\A([^-]*)-(.*)\z", 2)
    a, b, n = number(first), number(rest), number(t)
    ranged = F.when((a > 0) & (trim(rest) == ""), F.struct(a.alias("start"), F.lit(None).cast("bigint").alias("end"))).when((a > 0) & (b >= a), F.struct(a.alias("start"), b.alias("end")))
    return F.when(F.contains(t, F.lit("-")), ranged).when(n > 0, F.struct(F.lit(1).cast("bigint").alias("start"), n.alias("end")))


def apply_line_range(content: Column, start: Column, end: Column) -> Column:
    """Numbered lines start..end (end null: to the last), or a note if the file is shorter."""
    return let(lines(content), lambda all_: line_range(all_, start, end))


def line_range(all_: Column, start: Column, end: Column) -> Column:
    """apply_line_range() of lines that are at hand."""
    total = F.size(all_).cast("bigint")
    start = start.cast("bigint")
    last = F.least(F.coalesce(end.cast("bigint"), total), total)
    part = F.slice(all_, F.greatest(start, F.lit(1)).cast("int"), F.greatest(last - start + 1, F.lit(0)).cast("int"))
    # as %5d does: a number of more than five digits stays whole
    number = lambda n: F.concat(F.repeat(F.lit(" "), F.lit(5) - F.length(n)), n)
    numbered = F.array_join(F.transform(part, lambda x, i: F.concat(number((i.cast("bigint") + start).cast("string")), F.lit("\t"), x)), "\n")
    note = F.concat(F.lit("(file has "), total.cast("string"), F.lit(" lines, requested start at "), start.cast("string"), F.lit(")"))
    return F.when(start > total, note).otherwise(numbered)
