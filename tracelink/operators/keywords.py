"""Keywords of a lexicon table in texts.

Literal keywords of the lexicon - most of them, usually - are found together by one automaton in one pass over each text, however many they
are; only keywords with signs of a regular expression are matched one by one, in the JVM. The lexicon goes to the tasks in
groups of at most ``most_chars`` characters, each group a pass, so what a task holds is bounded.

Case counts, there are no word borders, and occurrences of one keyword do not overlap. Null and empty keywords are left out, repeated
lexicon rows count once, texts of fewer than two characters and null texts have no keywords, and empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelink.session import written

def literal(column: str = "keyword") -> Column:
    """Whether a keyword has no sign of a regular expression, so stands for itself."""
    return ~F.col(column).rlike(r"[\\^$.|?*+()\[\]{}]")


def _counted(df: DataFrame, words: list[str], classes: list[list[str]]) -> DataFrame:
    """(key, keyword, class, count) of literal keywords; a keyword may have several classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for i, word in enumerate(words):
            automaton.add_word(word, i)
        automaton.make_automaton()
        sizes = [len(w) for w in words]
        for batch in batches:
            rows, found, kinds, counts = [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                ends: dict[int, int] = {}
                n: dict[int, int] = {}
                for end, i in automaton.iter(text):
                    if end - sizes[i] >= ends.get(i, -1):  # begins after the last one counted
                        ends[i], n[i] = end, n.get(i, 0) + 1
                for i, count in n.items():
                    for c in classes[i]:
                        rows.append(row), found.append(words[i]), kinds.append(c), counts.append(count)
            yield pa.record_batch([batch.column("key").take(pa.array(rows, pa.int64())), pa.array(found, pa.string()), pa.array(kinds, pa.string()), pa.array(counts, pa.int64())], names=["key", "keyword", "class", "count"])

    kind = dict(df.dtypes)["key"]
    return df.mapInArrow(run, f"key {kind}, keyword string, class string, count long")


def _matched(df: DataFrame, keywords: list[tuple[str, str]]) -> DataFrame:
    """The same for regular expressions, in one pass of expressions."""
    found = [F.struct(F.lit(k).alias("keyword"), F.lit(c).alias("class"), F.regexp_count(F.col("text"), F.lit(k)).cast("long").alias("count")) for k, c in keywords]
    return df.select("key", F.explode(F.filter(F.array(*found), lambda s: s["count"] > 0)).alias("k")).select("key", "k.*")


def tag_keywords(df: DataFrame, key: str, column: str, lexicon: DataFrame, most_chars: int = 4_000_000) -> DataFrame:
    """(key, keyword, class, count): occurrences of each keyword of ``lexicon`` (keyword, class) in the texts of ``column``."""
    texts = df.where(F.length(column) >= 2).select(F.col(key).alias("key"), F.col(column).alias("text"))
    own = lexicon.where("keyword <> ''").select("keyword", F.col("class").cast("string").alias("class")).distinct()
    own = written(own.withColumn("literal", literal()), "lexicon")
    chars = own.agg(F.sum(F.length("keyword"))).first()[0]
    out = [df.sparkSession.createDataFrame([], texts.select("key").schema.add("keyword", "string").add("class", "string").add("count", "long"))]
    groups = max(1, -(-(chars or 0) // most_chars))
    for group in range(groups if chars else 0):
        rows = own.where(F.pmod(F.xxhash64("keyword"), F.lit(groups)) == group).collect()
        classes: dict[str, list[str]] = {}
        for r in rows:
            if r.literal:
                classes.setdefault(r.keyword, []).append(r["class"])
        if classes:
            out.append(_counted(texts, list(classes), list(classes.values())))
        if any(not r.literal for r in rows):
            out.append(_matched(texts, [(r.keyword, r["class"]) for r in rows if not r.literal]))
    found = reduce(DataFrame.unionByName, out[1:] or out)
    return found.select(F.col("key").alias(key), "keyword", "class", "count")
