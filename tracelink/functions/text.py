"""Column expressions over text: extraction, cleaning, keys. Regular expressions stay inside the common
part of Java's and RE2's syntax. A null input gives null unless a function says otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


def digits(c: Column) -> Column:
    """Digits only; null when none remain."""
    return F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit(""))


def phone_key(c: Column, least: int = 7) -> Column:
    """Number words as digits, then digits only; fewer than ``least`` give ''."""
    spelled = reduce(lambda x, w: F.replace(x, F.lit(w[1]), F.lit(str(w[0]))), enumerate(NUMBER_WORDS), F.lower(c))
    only = F.regexp_replace(spelled, "[^0-9]", "")
    return F.when(F.length(only) >= least, only).otherwise("")


def first_match(c: Column, patterns: list[tuple[str, int]], digits_only: bool = False, cap: int = 45) -> Column:
    """The group of the first pattern that matches, in order; null if none. A value of more than ``cap``
    characters is cut to ``cap`` - 1."""
    found = [F.when(F.regexp_like(c, F.lit(p)), F.regexp_extract(c, p, g)) for p, g in patterns]
    value = F.coalesce(*found)
    if digits_only:
        value = digits(value)
    return F.when(F.length(value) > cap, F.substring(value, 1, cap - 1)).otherwise(value)


def strip_html(c: Column, keep: tuple[str, ...] = ()) -> Column:
    """Text without tags (but those in ``keep``) and with the five common references decoded, ampersand last."""
    if keep:  # kept tags are hidden from the removal
        out = F.regexp_replace(c, f"<(/?(?:{'|'.join(keep)}))>", "\u0001$1\u0002")
        out = F.regexp_replace(F.regexp_replace(out, "<[^>]*>", ""), "\u0001([^\u0002]*)\u0002", "<$1>")
    else:
        out = F.regexp_replace(c, "<[^>]*>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def split_values(c: Column, least: int = 4, deny: tuple[str, ...] = ()) -> Column:
    """Lower-case values of a comma-joined text, tags stripped, trimmed, of ``least`` characters at least, and
    without those that contain a denied part."""
    values = F.transform(F.split(F.lower(F.regexp_replace(c, "<[^>]*>", "")), ","), lambda v: F.trim(v))
    values = F.filter(values, lambda v: F.length(v) >= least)
    return reduce(_without, deny, values)


def _without(values: Column, part: str) -> Column:
    return F.filter(values, lambda v: ~F.contains(v, F.lit(part)))


def clean_text(c: Column, phrase: str = r"[0-9]+ (?:views|posts)") -> Column:
    """Lower case, no tags or references, no counter phrase, everything but letters and digits as one blank."""
    out = F.lower(c)
    for p in ("<[^>]*>", "&[a-z0-9#]+;", phrase, "[^a-z0-9]+"):
        out = F.regexp_replace(out, p, " ")
    return F.trim(out)


def url_subdomain(c: Column) -> Column:
    """What stands between // and the first dot; null if the url has no such part."""
    return F.nullif(F.regexp_extract(c, r"//([^./]+)\.", 1), F.lit(""))


def location_label(region: Column, city: Column, state: Column, country: Column, cap: int = 45) -> Column:
    """City, else region, else 'state,country'; of more than ``cap`` characters the last ``cap`` - 1."""
    known = lambda c: F.nullif(F.trim(c), F.lit(""))
    label = F.coalesce(known(city), known(region), F.nullif(F.concat_ws(",", known(state), known(country)), F.lit("")))
    return F.when(F.length(label) > cap, F.right(label, F.lit(cap - 1))).otherwise(label)


def day_bucket(ts: Column, mode: str = "day") -> Column:
    """Start of the calendar day (``day``), of the UTC day by division (``utc``), or of the half day (``half_day``)."""
    if mode == "day":
        return F.date_trunc("day", ts)
    seconds = {"utc": 86_400, "half_day": 43_200}[mode]
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / seconds) * seconds)


def content_hash(c: Column) -> Column:
    """Hexadecimal SHA-1 of a text's UTF-8 bytes; null for null, and a digest for an empty text."""
    return F.sha1(c.cast("binary"))


def to_hex(c: Column) -> Column:
    """Bytes, or a text's UTF-8 bytes, in lower-case hexadecimal; null for null, '' for ''."""
    return F.lower(F.hex(c))


def from_hex(c: Column) -> Column:
    """The bytes that hexadecimal digits stand for; null for null and for what is not hexadecimal."""
    return F.unhex(c)


def composite_key(cols: list[Column], sep: str = "|") -> Column:
    """The columns as text joined by ``sep``, null as the word null."""
    return F.concat_ws(sep, *(F.coalesce(c.cast("string"), F.lit("null")) for c in cols))


def fingerprint_key(c: Column) -> Column:
    """Distinct lower-case words in order: spellings that differ in case, marks or word order share it."""
    words = F.split(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), " ")
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def ngram_key(c: Column, n: int = 2) -> Column:
    """Distinct character n-grams of the letters and digits in order; a shorter text is its own key."""
    only = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(only) - (n - 1))), lambda i: F.substr(only, i, F.lit(n)))
    return F.array_join(F.array_sort(F.array_distinct(grams)), "")


def starts_any(tokens: Column, terms: list[str]) -> Column:
    """Whether for every term some token starts with it."""
    return reduce(lambda a, q: a & _starts(tokens, q.lower()), terms, F.lit(True))


def _starts(tokens: Column, term: str) -> Column:
    return F.exists(tokens, lambda t: F.startswith(t, F.lit(term)))


def tokens(c: Column) -> Column:
    """Lower-case words of a text."""
    return F.split(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), " ")


#: Steps of a sound key, as (pattern, replacement) in order: silent starts, then letters and groups by sound, then repeats, then vowels.
SOUNDS = (
    ("\\b[kgp]n", "n"), ("\\bwr", "r"), ("\\bx", "s"), ("\\bwh", "w"), ("mb\\b", "m"),
    ("sch", "sk"), ("tch", "x"), ("ch|sh", "x"), ("th", "0"), ("ph", "f"), ("gh", ""), ("dg", "j"), ("ck", "k"),
    ("c[eiy]", "si"), ("g[eiy]", "ji"), ("[cq]", "k"), ("x", "x"), ("v", "f"), ("z", "s"),
    *((f"{c}{c}+", c) for c in "bdfgjklmnprst"),
    ("\\B[aeiouyhw]", ""),
)


def sound_key(c: Column) -> Column:
    """The words of a text by sound, distinct and in order: spelling variants that are spoken alike share a key. Letters beyond a-z and digits part words."""
    out = F.lower(c)
    for pattern, replacement in (("[^a-z0-9]+", " "), *SOUNDS):
        out = F.regexp_replace(out, pattern, replacement)
    return F.array_join(F.array_sort(F.array_distinct(F.split(F.trim(out), " "))), " ")


def soundex_key(c: Column) -> Column:
    """The soundex codes of a text's words, distinct and in order."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z]+", " "), " "), lambda w: w != "")
    return F.array_join(F.array_sort(F.array_distinct(F.transform(words, F.soundex))), " ")
