"""Text helpers of audits and phrase rewriting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from logtide.functions.choice import bound

# Patterns of the audit.
YEARS = ("(?i)((?:copyright|\\(c\\)|©)(?:\\s*(?:\\(c\\)|©))?[\\s:]*)"
         "(?:19|20)\\d\\d(?:\\s*[-–,]\\s*(?:19|20)\\d\\d)*\\b")

_MARKERS = " \t\x0b\f*/"
_BLANK = r"[\s﻿]*+"
# Possessive throughout: Java then loops instead of recursing, however long a comment is
_COMMENT = r"(?://[^\n\r]*+|/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/|\z))"
_STATEMENT = r"(?:package|import)(?![A-Za-z0-9_$])[^;]*+;"


def abbreviate(text: Column) -> Column:
    return F.when(F.length(text) <= 80, text).otherwise(F.concat(F.substring(text, 1, 77), F.lit("...")))


def java_trim(text: Column) -> Column:
    """Without leading and trailing characters up to U+0020."""
    return F.regexp_replace(text, r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")


# One run of Unicode escapes, a backslash with what it escapes, or what has no backslash
_ESCAPES = r"(?s)((?:\\u++[0-9a-fA-F]{4})++|\\[^u]|[^\\]++|\\)"


def unescaped(source: Column) -> Column:
    """Java's Unicode escapes as their characters, read before anything else is; pairs of surrogates together."""
    pieces = F.regexp_extract_all(source, F.lit(_ESCAPES), 1)
    shown = F.transform(pieces, lambda p: F.when(
        p.rlike(r"\A\\u+[0-9a-fA-F]{4}"), F.decode(F.unhex(F.regexp_replace(p, r"\\u+", "")), "UTF-16BE")).otherwise(p))
    return F.when(source.contains("\\u"), F.array_join(shown, "")).otherwise(source)


def header(source: Column) -> Column:
    """The comments before a source text's first code, as one line of words.

    Comments before and among package and import statements count; those after the last one belong to
    what follows. Markers go, blanks collapse, and the years of copyright notices become `#`.
    """
    # What follows on from the start of the text: comments, and '' for each statement
    found = F.regexp_extract_all(unescaped(source), F.lit(rf"\G{_BLANK}(?:({_COMMENT})|{_STATEMENT})"), 1)
    text = bound(found, lambda all: F.array_join(_before_code(all), "\n"))
    text = bound(text, lambda t: F.when(t.contains("\r"), F.replace(t, F.lit("\r"), F.lit("\n"))).otherwise(t))
    # What opens and closes a comment are slashes and stars at the edge of a line like any other marker
    lines = F.transform(F.split(text, "\n"), lambda line: F.trim(line, F.lit(_MARKERS)))
    text = bound(F.array_join(F.filter(lines, lambda line: line != ""), " "), _collapsed)
    # The look-ahead only spares the engine the positions where no notice can start
    return F.coalesce(F.regexp_replace(text, "(?=[cC(©])" + YEARS, "$1#"), F.lit(""))


def _before_code(found: Column) -> Column:
    """The comments up to the last statement, or all if there is none."""
    last = F.size(found) - F.array_position(F.reverse(found), "") + 1
    return F.when(F.array_contains(found, ""), F.slice(found, F.lit(1), last.cast("int"))).otherwise(found)


def _collapsed(text: Column) -> Column:
    """Blanks within lines as one space. Most texts have none to collapse, which is cheap to see."""
    blanks = text.contains("  ") | text.contains("\t") | text.contains("\x0b") | text.contains("\f")
    return F.when(blanks, F.regexp_replace(text, r"[ \t\x0B\f]+", " ")).otherwise(text)
