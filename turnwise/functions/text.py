"""Text functions over segments: normalising, junk tests, labels and formats. All JVM-side but text_ratio."""

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

#: Phrases that are dropped where they are a segment's whole text.
BLOCKLIST = (
    "thank you",
    "thank you very much",
    "thank you for watching",
    "thanks for watching",
    "thanks for watching everyone",
    "please subscribe",
    "please subscribe to my channel",
    "you",
    "bye",
    "bye bye",
)
_WHITE = r"\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_IDEOGRAPHIC = r"[\x{3000}-\x{9fff}\x{f900}-\x{faff}\x{ff00}-\x{ffef}]"


def strip(text: Column) -> Column:
    """Without Unicode white space at either end (trim() knows the space alone)."""
    return F.regexp_replace(text, f"^[{_WHITE}]+|[{_WHITE}]+$", "")


def normalize(text: Column) -> Column:
    """Lower case, punctuation deleted, stripped; white space inside stays as it is."""
    return strip(F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}_{_WHITE}]", ""))


def is_cjk_junk(text: Column) -> Column:
    return text.rlike(_IDEOGRAPHIC) & ~text.rlike("[a-zA-Z]")


def in_blocklist(text: Column) -> Column:
    return normalize(text).isin(*BLOCKLIST)


def segment_label(channel: Column, speaker: Column) -> Column:
    """me for the microphone, else the speaker, else them; an empty speaker counts as none."""
    return F.when(channel == "mic", "me").otherwise(F.coalesce(F.nullif(speaker, F.lit("")), F.lit("them")))


def speaker_label(index: Column) -> Column:
    return F.concat(F.lit("Speaker "), (index + 1).cast("string"))


def format_timestamp(seconds: Column) -> Column:
    """m:ss, from an hour on h:mm:ss; fractions are cut."""
    s = seconds.cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(r))).otherwise(F.concat_ws(":", m.cast("string"), two(r)))


def format_duration(seconds: Column) -> Column:
    """1h 5m, 2h or 48m; below zero counts as zero."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    h, m = F.floor(s / 3600).cast("string"), F.floor(s % 3600 / 60).cast("string")
    hm = F.when((s >= 3600) & (s % 3600 >= 60), F.concat(h, F.lit("h "), m, F.lit("m")))
    return hm.when(s >= 3600, F.concat(h, F.lit("h"))).otherwise(F.concat(m, F.lit("m")))


def word_count(text: Column) -> Column:
    """Words parted by white space: the default token count."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def text_similarity(mic: Column, system: Column) -> Column:
    """1 - edit distance over the longer length: a ratio that stays in the JVM. Two empty texts are alike."""
    longer = F.greatest(F.length(mic), F.length(system))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(mic, system) / longer)


def characters(text: Column) -> Column:
    """How often a text holds each of its characters."""
    all_of = F.filter(F.split(text, ""), lambda c: c != "")
    return F.map_from_entries(F.transform(F.array_distinct(all_of), lambda c: F.struct(c, F.size(F.filter(all_of, lambda x: x == c)))))


def ratio_bound(a: Column, b: Column, own: Column, other: Column) -> Column:
    """What text_ratio(a, b) can't exceed: matching characters are no more than those that both texts hold, by their characters()."""
    both = F.aggregate(F.map_entries(own), F.lit(0), lambda n, e: n + F.least(e["value"], F.coalesce(F.try_element_at(other, e["key"]), F.lit(0))))
    return F.when(F.length(a) + F.length(b) == 0, 1.0).otherwise(2 * both / (F.length(a) + F.length(b)))


def length_bound(a: Column, b: Column) -> Column:
    """As ratio_bound, by the lengths alone."""
    return F.when(F.length(a) + F.length(b) == 0, 1.0).otherwise(2 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b)))


def json_fields(line: Column, schema: str) -> Column:
    """A JSON object's fields as a struct; a line that is no object of these types, or lacks one of them, is an error."""
    found = F.from_json(line, schema, {"mode": "FAILFAST"})
    names = [part.split()[0] for part in schema.split(",")]
    lacking = F.filter(F.array(*(F.when(found[n].isNull(), F.lit(n)) for n in names)), lambda n: n.isNotNull())
    return F.when(F.size(lacking) > 0, F.raise_error(F.concat(F.lit("no "), F.array_join(lacking, ", "), F.lit(" in "), F.coalesce(line, F.lit("null"))))).otherwise(found)


@pandas_udf(DoubleType())
def text_ratio(mic: pd.Series, system: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; it is not symmetric, so the microphone's text comes first."""
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(mic, system, strict=True)], dtype=float)
