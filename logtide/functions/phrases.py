"""Phrase lines, requests and language codes as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from logtide.functions.texts import java_trim

# What a language code looks like and other codes for known languages.
CODE = "[a-z0-9]{1,8}(-[a-z0-9]{1,8}){0,4}"
ALIASES = {"zh": "zh-cn", "zh-hans": "zh-cn", "zh-sg": "zh-cn", "zh-hant": "zh-tw", "zh-hk": "zh-tw",
           "zh-mo": "zh-tw", "iw": "he"}
# How a request carries its JSON object.
BODY_PREFIX = "data="
PLUS_SIGN = "{PLUS_SIGN}"


def phrase_name(line: Column) -> Column:
    """The phrase a `NAME: text` line sets, or null for comments and lines without a colon."""
    split = F.instr(line, ":")
    return F.when((split > 0) & ~line.startswith("#"), F.upper(java_trim(F.substring_index(line, ":", 1))))


def unquote(text: Column) -> Column:
    """Without matching quotes around it and their escapes."""
    inner = F.substr(text, F.lit(2), F.length(text) - 2)
    single = F.replace(F.replace(F.replace(inner, F.lit("''"), F.lit("'")), F.lit("\\'"), F.lit("'")),
                       F.lit("\\\\"), F.lit("\\"))
    double = F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    long = F.length(text) >= 2
    return (F.when(long & text.startswith("'") & text.endswith("'"), single)
            .when(long & text.startswith('"') & text.endswith('"'), double).otherwise(text))


def phrase_text(line: Column) -> Column:
    return unquote(java_trim(F.substr(line, F.instr(line, ":") + 1)))


def blank(text: Column) -> Column:
    return java_trim(text) == ""


def request_json(body: Column) -> Column:
    """The JSON text of a request body, plain or form-encoded; null if it is neither."""
    data = F.substr(body, F.lit(len(BODY_PREFIX) + 1))
    plain = F.replace(data, F.lit(PLUS_SIGN), F.lit("+"))
    return F.when(body.startswith(BODY_PREFIX),
                  F.when(data.startswith("{"), plain).otherwise(F.try_url_decode(data)))


def language_code(text: Column) -> Column:
    """A language setting as a code: trimmed, lower case, dashes; null if it cannot be one."""
    code = F.translate(F.lower(java_trim(text)), "_ı", "-i")
    return F.when(code.rlike(rf"\A{CODE}\z"), code)


def language_choices(code: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """Codes to try in order: the code, its alias, then the same without the last part, and so on."""
    parts = F.split(code, "-")
    prefixes = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)),
                           lambda n: F.array_join(F.slice(parts, 1, n), "-"))
    names = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.flatten(F.transform(prefixes, lambda p: F.filter(
        F.array(p, F.element_at(names, p)), lambda c: c.isNotNull())))
