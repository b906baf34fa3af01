"""Column expressions over text: normalisation, words, byte trigrams, snippets, names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of Unicode White_Space, spelled out: Java's ``\s`` is ASCII only.
WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: The same characters for Python.
WS_CHARS = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SNIPPET_CHARS = 256
CONTENT_BYTES = 8000


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with the value computed once a row.

    A projection is inlined wherever its column is used, also into lambdas, where
    it would be computed for every element; a lambda's own variable is not.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


def normalize(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), WS, " "))


def words(text: Column) -> Column:
    """White-space-delimited lower-case words."""
    return F.filter(F.split(F.lower(text), WS), lambda w: w != "")


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def trigrams(data: Column) -> Column:
    """All 3-byte windows of a binary column in order; none if it is shorter."""

    def windows(d: Column) -> Column:
        own = F.transform(F.sequence(F.lit(1), F.octet_length(d) - 2), lambda i: F.substring(d, i, F.lit(3)))
        return F.when(F.octet_length(d) >= 3, own).otherwise(F.array().cast("array<binary>"))

    return let(data, windows)


def distinct_trigrams(data: Column) -> Column:
    return F.array_distinct(trigrams(data))


def overlap(query: Column, doc: Column) -> Column:
    """Share of the query's trigrams that the document has; 0 for an empty query."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, doc)) / F.size(query)).otherwise(F.lit(0.0))


def snippet(text: Column) -> Column:
    return F.substring(text, 1, SNIPPET_CHARS)


def contextual_snippet(text: Column, query: str, fallback: Column, context: int) -> Column:
    """Text around the first query word of three bytes or more that occurs, in query order.

    ``context`` characters on either side; trimmed, line ends as spaces, with dots
    where text was left out; the fallback if no word occurs.
    """
    lower = F.lower(text)
    at = F.lit(None).cast("int")
    for word in reversed([w for w in split_words(query) if len(w.encode()) >= 3]):
        found = F.instr(lower, F.lit(word.lower()))
        at = F.when(found > 0, found).otherwise(at)
    start, end = F.greatest(at - 1 - context, F.lit(0)), F.least(at - 1 + context, F.length(text))
    body = F.replace(F.regexp_replace(F.substring(text, start + 1, end - start), f"^{WS}|{WS}$", ""), F.lit("\n"), F.lit(" "))
    out = F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(end < F.length(text), "...").otherwise(""))
    return F.when(at.isNull(), fallback).otherwise(out)


def full_content(text: Column, limit: int = CONTENT_BYTES) -> Column:
    """The text, or at most ``limit`` bytes of it cut at a character and at the last white space, with dots."""
    data = utf8(text)
    # a byte 80-BF after the cut continues a character: step back to where it starts
    inside = F.lit(limit)
    for k in (1, 2, 3):
        cont = F.conv(F.hex(F.substring(data, limit + 2 - k, 1)), 16, 10).cast("int").between(0x80, 0xBF)
        inside = F.when((inside == limit - k + 1) & cont, F.lit(limit - k)).otherwise(inside)
    cut = F.decode(F.substring(data, F.lit(1), inside), "UTF-8")
    last = F.regexp_extract(cut, f"(?s)^(.*){WS[:-1]}", 1)
    has_space = F.regexp_like(cut, F.lit(WS))
    return F.when(F.octet_length(data) <= limit, text).otherwise(F.concat(F.when(has_space, last).otherwise(cut), F.lit("...")))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def file_stem(path: Column) -> Column:
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1))


def under(path: Column, prefix: str) -> Column:
    """Whether the path is the prefix or below it, by whole components."""
    prefix = prefix.rstrip("/") or "/"
    return F.lit(True) if prefix == "/" else (path == prefix) | F.startswith(path, F.lit(prefix + "/"))


def split_words(text: str) -> list[str]:
    """White-space-delimited words of a Python string, by the same characters as WS."""
    out = [""]
    for c in text:
        if c in WS_CHARS:
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def query_trigrams(word: str) -> list[bytes]:
    """Distinct trigrams of a query word, normalised, in order."""
    data = " ".join(split_words(word.lower())).encode()
    return list(dict.fromkeys(data[i : i + 3] for i in range(len(data) - 2)))
