"""Scalar functions on text, numbers and vectors, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"[\x{4e00}-\x{9fff}]"
#: Punctuation that a comparison of wordings ignores, whitespace included (fixed values).
IGNORED = r"[\s，。、！？：；「」『』（）,.!?:;\"'()\-—…]+"


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over code points."""
    return F.levenshtein(a, b)


def sound_key(text: Column, readings: Column) -> Column:
    """The readings of the characters, joined; a character without one stands for itself. readings: map<string,string>."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(readings, c), c)), "")


def normalize(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)" + IGNORED, "")


def _own_upper(c: str) -> str:
    """The upper case of a character in one character; sharp s has a capital of its own, ligatures have none."""
    return "\u1e9e" if c == "\u00df" else next((u for u in (c.upper(), c.title()) if len(u) == 1), c)


#: The letters that have another upper case (all are below 0x20000), and those.
LOWER = "".join(c for c in map(chr, range(0x20000)) if _own_upper(c) != c)
UPPER = "".join(map(_own_upper, LOWER))


def upper_by_character(text: Column) -> Column:
    """Each character's own upper case, so that the text keeps its length; F.upper writes SS for sharp s."""
    return F.translate(text, LOWER, UPPER)


def places(chars: Column, n: int) -> Column:
    """For each place of a text cut into characters: ``was``, the n characters from there, and ``now``, the one after them.

    At the end of the text there are fewer, and now is empty. chars is a column of its own, as F.split(text, "") gives.
    """
    return F.transform(chars, lambda _, i: F.struct(F.concat_ws("", *(F.get(chars, i + k) for k in range(n))).alias("was"), F.coalesce(F.get(chars, i + n), F.lit("")).alias("now")))


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def word_characters(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\W+", "")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a vector of zeros gives 0."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def unit(a: Column) -> Column:
    """The vector at length 1, so that a dot product is a cosine; zeros stay."""
    size = F.array(F.sqrt(dot(a, a)))
    return F.get(F.transform(size, lambda n: F.transform(a, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n))), F.lit(0))


def convert_script(text: Column, source: str, target: str) -> Column:
    """Character by character; source and target list the characters that differ, in step."""
    return F.translate(text, source, target)


def clock(seconds: Column) -> Column:
    """h:mm:ss, or mm:ss below an hour."""
    s = F.floor(seconds).cast("long")
    long_, short = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60), F.format_string("%02d:%02d", F.floor(s / 60), s % 60)
    return F.when(s >= 3600, long_).otherwise(short)


def minute_second(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def vtt_time(seconds: Column) -> Column:
    """hh:mm:ss.mmm; the whole value is rounded to milliseconds before it is cut up."""
    ms = F.bround(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def speaker_code(n: Column) -> Column:
    return F.when(n < 0, F.lit("")).otherwise(F.concat(F.lit("S"), (n + 1).cast("string")))


def code_number(code: Column) -> Column:
    """The number of an S-code, null for anything else."""
    return F.regexp_extract(code, r"^S([0-9]{1,9})$", 1).try_cast("int")


def target_chars(total: Column) -> Column:
    return F.least(F.greatest(F.floor(total / 6), F.lit(400)), F.lit(8000)).cast("long")


def max_tokens(target: Column) -> Column:
    return target * 2 + 800


def item_text(item: Column) -> Column:
    """The text of a summary item that is either {"text": ...} or a bare string."""
    return F.coalesce(F.get_json_object(item, "$.text"), item)


def han_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(HAN))


def mostly_han(text: Column) -> Column:
    return han_count(text) * 2 >= F.length(normalize(text))


def strip_think(text: Column, opening: str = "<think>", closing: str = "</think>") -> Column:
    return F.trim(F.regexp_replace(text, rf"(?s){opening}.*?{closing}", ""))


def first_json(text: Column) -> Column:
    """The text from the first { to the last } if it is a JSON object, else null."""
    outer = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(outer).isNotNull() & (F.get_json_object(outer, "$").isNotNull()), outer)


def target_languages(configured: Column, lang: Column) -> Column:
    return F.filter(configured, lambda x: ~x.eqNullSafe(lang))


def shown_languages(configured: Column, lang: Column, translations: Column) -> Column:
    return F.filter(target_languages(configured, lang), lambda x: F.coalesce(F.try_element_at(translations, x), F.lit("")) != "")


def ascii_fold(text: Column) -> Column:
    """Lower case for A-Z only, as a case-insensitive LIKE on ASCII folds."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
