"""Text as columns: words, windows, sentences, keys. Everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as blank (Unicode white space and the ASCII separators), where a
#: sentence ends (a closing quote or bracket there is consumed), and what a blank paragraph border is.
BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SENTENCE_END = rf"""(?<=[.!?])["')\]]?{BLANK}+(?=[A-Z0-9])"""
PARAGRAPH = rf"\n{BLANK}*\n"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for a row however often body names it, in lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Without blanks at both ends, in time proportional to the length however many blanks stand within."""
    return F.btrim(c, F.lit(BLANKS))


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{BLANK}+"), lambda w: w != "")


def window_starts(n: Column, size: int, step: int) -> Column:
    """0, 1, ...: numbers of windows up to the first that reaches the end; none for nothing."""
    last = F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int"))
    return F.when(n > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def checked_window(size: int, overlap: int) -> int:
    """The step from a window to the next one."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size > 0 and 0 <= overlap < size are needed")
    return size - overlap


def joined_windows(parts: Column, size: int, step: int, glue: str) -> Column:
    return let(parts, lambda p: F.transform(window_starts(F.size(p), size, step), lambda k: F.array_join(F.slice(p, k * step + 1, F.lit(size)), glue)))


def fixed_windows(c: Column, size: int = 512, overlap: int = 50) -> Column:
    return joined_windows(words(c), size, checked_window(size, overlap), " ")


def paragraphs(c: Column) -> Column:
    """Parts between blank lines; between lines, if that gives one part only."""
    parts = lambda pattern: F.filter(F.transform(F.split(c, pattern), strip), lambda p: p != "")
    return let(parts(PARAGRAPH), lambda p: F.when(F.size(p) > 1, p).otherwise(parts("\n")))


def paragraph_groups(c: Column, size: int = 2, overlap: int = 1) -> Column:
    return joined_windows(paragraphs(c), size, checked_window(size, overlap), "\n\n")


def summary_windows(c: Column, size: int = 500, overlap: int = 0, summary: int = 150) -> Column:
    """Character windows, each behind the text's own beginning."""
    step = checked_window(size, overlap)
    if summary < 0:
        raise ValueError("summary >= 0 is needed")

    def windows(text: Column) -> Column:
        head = strip(F.replace(F.substring(text, 1, summary), F.lit("\n"), F.lit(" ")))
        prefix = F.when(head != "", F.concat(head, F.lit("\n\n"))).otherwise("")
        return let(prefix, lambda p: F.transform(window_starts(F.length(text), size, step), lambda k: F.concat(p, F.substr(text, k * step + 1, F.lit(size)))))

    return let(strip(c), windows)


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(strip(c), SENTENCE_END), strip), lambda s: s != "")


def letters(i: Column) -> Column:
    """a..z, aa..zz, aaa..: bijective in base 26, up to five letters (12,356,630)."""
    out, before, size = None, 0, 26
    for width in range(1, 6):
        digits = F.concat(*[F.char(97 + F.floor((i - before) / 26**k) % 26) for k in reversed(range(width))])
        out = F.when(i < before + size, digits) if out is None else out.when(i < before + size, digits)
        before, size = before + size, size * 26
    return out


def keyed(parts: Column, prefix: Column) -> Column:
    return F.transform(parts, lambda s, i: F.struct(F.concat(prefix, letters(i)).alias("key"), s.alias("text")))


def keyed_sentences(c: Column, prefix: Column) -> Column:
    """The sentences of an answer, or of one document, with their keys."""
    return keyed(sentences(c), prefix)


def keyed_documents(documents: Column) -> Column:
    """documents: the sentences of each. Keys begin with the document's number; one without sentences still has a number."""
    return F.transform(documents, lambda d, i: keyed(d, i.cast("string")))


def split_documents(texts: Column) -> Column:
    return F.transform(texts, lambda t: sentences(F.coalesce(t, F.lit(""))))


def segmented(texts: Column, answer: Column) -> Column:
    """What a judge labels: keyed sentences of all documents and of the answer (plain letters)."""
    return F.struct(keyed_documents(split_documents(texts)).alias("documents"), keyed_sentences(F.coalesce(answer, F.lit("")), F.lit("")).alias("response"))


def token_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1))
