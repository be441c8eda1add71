"""Phrase tables: reading, layering, coverage, languages and rewriting."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logtide.functions.phrases import blank, language_choices, language_code, phrase_name, phrase_text, request_json


def parse_phrases(lines: DataFrame, line: str, at: str, file: str | None = None) -> DataFrame:
    """Phrases of `NAME: text` lines, the last line (by `at`) of a name winning within its file."""
    by = [file] if file else []
    named = lines.select(*by, F.col(at).alias("at"), phrase_name(F.col(line)).alias("name"),
                         phrase_text(F.col(line)).alias("text")).filter(F.col("name").isNotNull())
    return named.groupBy(*by, "name").agg(F.max_by("text", "at").alias("text"))


def read_phrase_files(spark: SparkSession, path: str) -> DataFrame:
    """Phrases of language files, by the language in the file's name. One file is one small text."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    language = F.translate(F.lower(F.regexp_replace("file", r"\.[^.]*\z", "")), "_", "-")
    lines = files.select(language.alias("language"), F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("at", "line"))
    return parse_phrases(lines, "line", "at", "language")


def json_string_entries(df: DataFrame, id: str, json: str) -> tuple[DataFrame, DataFrame]:
    """(entries, rejects): the string members of a column of JSON objects, and the rows that hold no object.

    Members of other types are skipped.
    """
    # The parser stops after one value. Read the text inside an array, before a mark no text can
    # contain, its own hash: only a text that is one whole value leaves the mark second of two.
    mark = F.md5(F.col(json).cast("binary"))
    framed = F.try_parse_json(F.concat(F.lit("["), F.col(json), F.lit(',"'), mark, F.lit('"]')))
    parsed = (df.select(F.col(id), F.col(json).alias("json"), mark.alias("mark"), framed.alias("framed"))
              .select(id, "json", F.try_variant_get("framed", "$[0]", "variant").alias("v"),
                      (F.try_variant_get("framed", "$[1]", "string").eqNullSafe(F.col("mark"))
                       & F.try_variant_get("framed", "$[2]", "variant").isNull()).alias("whole")))
    is_object = F.col("whole") & F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    rejects = parsed.filter(~is_object).select(id, "json")
    members = parsed.filter(is_object).select(id, F.explode(F.col("v").cast("map<string,variant>")).alias("name", "value"))
    entries = (members.filter(F.schema_of_variant("value") == "STRING")
               .select(id, "name", F.variant_get("value", "$", "string").alias("text")))
    return entries, rejects


def decode_requests(df: DataFrame, id: str, body: str) -> DataFrame:
    """The JSON text each request body carries, null where it is not a request."""
    return df.select(F.col(id), request_json(F.col(body)).alias("json"))


def uncustomized(sent: DataFrame, translations: DataFrame, defaults: DataFrame, keys: list[str] = ("name",)) -> DataFrame:
    """Translations that are not blank, of phrases sent with their default text."""
    on = list(keys)
    plain = (sent.select(*on, F.col("text").alias("sent"))
             .join(defaults.select("name", F.col("text").alias("default")), "name")
             .filter(F.col("sent") == F.col("default")).select(*on))
    return translations.filter(~blank(F.col("text"))).join(plain, on, "left_semi")


def layer_phrases(base: DataFrame, over: DataFrame, keys: list[str] = ("name",)) -> DataFrame:
    """The upper table's text where it is not blank, else the lower one's, and where it came from."""
    on = list(keys)
    upper = over.filter(~blank(F.col("text"))).select(*on, F.col("text").alias("upper"))
    lower = base.select(*on, F.col("text").alias("lower"))
    return lower.join(upper, on, "full_outer").select(
        *on, F.coalesce("upper", "lower").alias("text"),
        F.when(F.col("upper").isNotNull(), "over").otherwise("base").alias("provenance"))


def phrase_coverage(phrases: DataFrame, names: DataFrame) -> DataFrame:
    """Per language: known phrases (not blank), missing and unknown ones, and the missing names.

    `names` are the phrases there should be, a list as long as the program has phrases.
    """
    wanted = names.select("name").distinct()
    marked = (phrases.select("language", "name", blank(F.col("text")).alias("blank"))
              .groupBy("language", "name").agg(F.bool_and("blank").alias("blank"))
              .join(wanted.withColumn("wanted", F.lit(True)), "name", "left"))
    everything = wanted.agg(F.array_sort(F.collect_set("name"))).scalar()
    known = F.col("wanted").isNotNull() & ~F.col("blank")
    counted = marked.groupBy("language").agg(
        F.count_if(known).alias("known"), F.count_if(F.col("wanted").isNull()).alias("unknown"),
        F.collect_set(F.when(known, F.col("name"))).alias("have"))
    missing = F.array_except(everything, F.col("have"))
    return counted.select("language", "known", F.size(missing).cast("bigint").alias("missing"), "unknown",
                          F.array_join(missing, ", ").alias("missing_names"))


def unknown_phrases(phrases: DataFrame, names: DataFrame) -> DataFrame:
    return phrases.select("language", "name").distinct().join(names.select("name").distinct(), "name", "left_anti")


def phrase_differences(left: DataFrame, right: DataFrame, keys: list[str] = ("name",)) -> DataFrame:
    """Phrases that both tables have with different texts."""
    on = list(keys)
    return (left.select(*on, F.col("text").alias("left_text"))
            .join(right.select(*on, F.col("text").alias("right_text")), on)
            .filter(~F.col("left_text").eqNullSafe(F.col("right_text"))).select(*on))


def resolve_languages(df: DataFrame, lang: str, available: DataFrame) -> DataFrame:
    """Each distinct language setting with the available language that serves it, or null.

    Works on the distinct settings; join it back to the rows that carry them.
    """
    asked = df.select(F.col(lang).alias("asked")).distinct()
    choices = asked.select("asked", F.posexplode(language_choices(language_code(F.col("asked")))).alias("rank", "language"))
    served = (choices.join(available.select("language").distinct(), "language", "left_semi")
              .groupBy("asked").agg(F.min_by("language", "rank").alias("resolved")))
    return asked.join(served.withColumnRenamed("asked", "served"), F.col("asked") == F.col("served"), "left").select(
        "asked", "resolved")


@dataclass(frozen=True)
class RewriteRules:
    """What happens to phrases by name, and the shapes in which texts show `old_name`."""
    old_name: str
    new_name: str
    dropped: tuple[str, ...] = ()
    self_naming: tuple[str, ...] = ()
    fixed: dict[str, str] = field(default_factory=dict)
    #: name -> (label, link); the whole text becomes `label: link`
    links: dict[str, tuple[str, str]] = field(default_factory=dict)
    #: name -> (old link, label, new link); only the link changes where the text shows it
    relinked: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    #: (what stands before a displayed name and stays, what follows it), as patterns
    contexts: tuple[tuple[str, str], ...] = ()


def rebrand(text: Column, rules: RewriteRules) -> Column:
    """The old name becomes the new one wherever one of the rules' contexts surrounds it."""
    new = rules.new_name.replace("\\", "\\\\").replace("$", "\\$")
    for before, after in rules.contexts:
        ahead = f"(?={after})" if after else ""
        text = F.regexp_replace(text, rf"({before})\Q{rules.old_name}\E{ahead}", f"$1{new}")
    return text


def rewrite_text(df: DataFrame, name: str, text: str, rules: RewriteRules) -> DataFrame:
    """Texts as the rules show them; dropped phrases disappear, others are rebranded where they name the program."""
    n, t = F.col(name), F.col(text)
    new = rebrand(t, rules)
    if rules.self_naming:
        new = F.when(n.isin(*rules.self_naming), F.replace(t, F.lit(rules.old_name), F.lit(rules.new_name))).otherwise(new)
    for key, value in rules.fixed.items():
        new = F.when(n == key, F.lit(value)).otherwise(new)
    for key, (label, link) in rules.links.items():
        new = F.when(n == key, F.lit(f"{label}: {link}")).otherwise(new)
    for key, (old, label, link) in rules.relinked.items():
        shown = F.when(t.contains(old), F.replace(t, F.lit(old), F.lit(link))).otherwise(F.lit(f"{label}: {link}"))
        new = F.when(n == key, shown).otherwise(new)
    kept = df if not rules.dropped else df.filter(n.isNull() | ~n.isin(*rules.dropped))
    return kept.withColumn(text, new)
