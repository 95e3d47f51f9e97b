"""Ranked lexical search by NRA: sequential reads of impact-sorted lists, with score intervals, until nothing is open.

Documents are dealt into shards as they are read. A shard has, of every document, its number of terms and, of every term that a query
has, its occurrences. Over all shards the numbers of documents and terms and each term's document frequency are added up, which
fixes the weights. Then each shard's occurrences become one list for each term, sorted by impact, and every query reads its terms'
lists from the top, step by step. What it has read of a document is the lower end of the document's score; the upper end adds, for each list
that the document was not met in, the last impact read there. Reading ends when no document that was never met can reach the k-th best lower
end and no document that can reach it has an open interval: membership, ties and scores are then exact. A task starts each
shard from the k-th best score of the shards that it has read before. The shards' best are merged by rank.

Queries are taken in groups of about ``most_terms`` terms, each a pass over the documents, so what a task holds of
the queries is bounded. Every document is indexed and counted whole.

Edge cases: null texts have no terms; a document without terms counts nowhere; a query without terms, or whose terms no document
has, gives no rows; repeated queries and query ids are answered each; repeated document rows are documents each; rows with a null
doc_id count in the statistics and come last among equal scores; an empty table of either kind gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelink.llm.common import release, sized, small_batches, texts_of, words
from tracelink.session import written

#: ASCII other than digits and letters stands between terms.
APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Occurrences that a shard holds at most, but for the last batch added.
SHARD = 1_500_000
SHARDS = "doc_id array<long>, n array<long>, doc array<int>, term array<int>, tf array<int>, terms array<int>, df array<long>"
RANKED = "query int, doc_id long, score long"


class Shard:
    """What a task gathers of its documents until it is written as a row."""

    def __init__(self, vocabulary: pa.Array) -> None:
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.docs, self.n, self.rows, self.size, self.held = [], [], [], 0, 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        found, starts = words(texts, APART)
        coded = found.dictionary_encode()
        place = np.asarray(pc.fill_null(pc.index_in(coded.dictionary, value_set=self.vocabulary), -1)).astype(np.int64)
        terms = place[np.asarray(coded.indices)] if len(coded.dictionary) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(texts)), np.diff(starts))
        asked = terms >= 0
        width = max(1, len(self.vocabulary))
        pairs, tf = np.unique((doc[asked] + self.size) * width + terms[asked], return_counts=True)
        self.rows.append((pairs // width, pairs % width, tf))
        self.docs.append(ids.cast(pa.int64()))
        self.n.append(np.diff(starts))
        self.size, self.held = self.size + len(texts), self.held + len(pairs)

    def batch(self) -> pa.RecordBatch:
        doc, term, tf = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        terms, df = np.unique(term, return_counts=True)
        columns = [pa.concat_arrays(self.docs), np.concatenate(self.n), doc.astype(np.int32), term.astype(np.int32), tf.astype(np.int32), terms.astype(np.int32), df]
        self.clear()
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c if isinstance(c, pa.Array) else pa.array(c)) for c in columns]
        return pa.record_batch(lists, names=[c.split()[0] for c in SHARDS.split(", ")])


def shards(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """Rows of ``SHARDS`` over all documents (doc_id, text): place in the shard, term and occurrences of each pair, and document frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(vocabulary)
        for batch in batches:
            for part in sized(batch, "text"):
                shard.add(part.column("doc_id"), texts_of(part, "text"))
                if shard.held >= SHARD or shard.size >= 65_536:
                    yield shard.batch()
        if shard.size:
            yield shard.batch()
        release()

    with small_batches(docs.sparkSession):
        return written(docs.select("doc_id", "text").mapInArrow(run, SHARDS), "lexical-shards")


def nra(lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents and scores of all that may be among the ``k`` best of ``size`` documents and reach ``floor``, and the entries read.

    ``lists`` has, for each term, places of documents and their impacts, largest impact first.
    """
    lower = np.zeros(size, np.int64)
    met = np.zeros((len(lists), size), bool)
    at = np.zeros(len(lists), np.int64)
    last = np.array([v[0] if len(v) else 0 for _, v in lists], np.int64)
    step, read = 2 * k, 0
    while True:
        for t, (doc, value) in enumerate(lists):
            if at[t] < len(doc):
                now = doc[at[t] : at[t] + step]
                part = value[at[t] : at[t] + step]
                lower[now] += part
                met[t, now] = True
                at[t] += len(now)
                read += len(now)
                last[t] = part[-1] if at[t] < len(doc) else 0
        step *= 2
        unseen = int(last.sum())
        least = floor if size <= k else max(floor, int(np.partition(lower, size - k)[size - k]))
        if unseen >= least:  # a document that was never met may still enter, or tie
            continue
        able = np.flatnonzero(lower + unseen >= least)
        able = able[lower[able] > 0]
        upper = lower[able] + unseen - last @ met[:, able]
        if ((upper > lower[able]) & (upper >= least)).any():
            continue
        able = able[lower[able] >= least]
        return able, lower[able], read


class Best:
    """The ``k`` best documents of each query so far; ties to smaller ids, null ids last."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * queries

    def floor(self, query: int) -> int:
        scores = self.found[query][1]
        return int(scores[-1]) if len(scores) >= self.k else 1

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray, null: np.ndarray) -> None:
        ids, scores, null = (np.concatenate(x) for x in zip(self.found[query], (ids, scores, null), strict=True))
        order = np.lexsort((ids, null, -scores))[: self.k]
        self.found[query] = ids[order], scores[order], null[order]

    def batches(self) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(self.found), 1000):
            part = self.found[lo : lo + 1000]
            query = np.repeat(np.arange(lo, lo + len(part)), [len(x[0]) for x in part])
            ids, scores, null = (np.concatenate(x) for x in zip(*part, strict=True))
            yield pa.record_batch([pa.array(query.astype(np.int32)), pa.array(ids, mask=null), pa.array(scores)], names=["query", "doc_id", "score"])


def _group(docs: DataFrame, texts: list[str], k: int) -> DataFrame:
    """Rows of ``RANKED`` with rank: the k best documents of each text, by its place in ``texts``."""
    spark = docs.sparkSession
    found, starts = words(pa.array(texts, pa.large_string()), APART)
    coded = found.dictionary_encode()
    vocabulary, codes = coded.dictionary, np.asarray(coded.indices)
    asked = [np.unique(codes[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
    own = shards(docs, vocabulary)
    total, length = own.select(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + F.when(x > 0, 1).otherwise(0)).alias("d"), F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("l")).agg(F.sum("d"), F.sum("l")).first()
    if not length:
        return spark.createDataFrame([], RANKED + ", rank int")
    df = own.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df").alias("df")).collect()  # a number for each term of the queries
    weights = np.zeros(len(vocabulary), np.int64)
    for term, n in df:
        weights[term] = math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(asked), k)
        for batch in batches:
            for row in range(batch.num_rows):
                column = lambda name, row=row, batch=batch: batch.column(name)[row].values
                ids, n, doc, term, tf = (column(c) for c in ("doc_id", "n", "doc", "term", "tf"))
                null = np.asarray(ids.is_null())
                ids, n = np.asarray(pc.fill_null(ids, 0)), np.asarray(n)
                doc, term, tf = (np.asarray(x).astype(np.int64) for x in (doc, term, tf))
                sizes, which = np.unique(n, return_inverse=True)
                m = np.array([100 - 50 + 50 * int(x) * total // length for x in sizes], np.int64)[which]
                impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[doc])
                order = np.lexsort((doc, -impact, term))
                doc, impact = doc[order], impact[order]
                begins = np.searchsorted(term[order], np.arange(len(weights) + 1))
                for q, terms in enumerate(asked):
                    lists = [(doc[begins[t] : begins[t + 1]], weights[t] * impact[begins[t] : begins[t + 1]]) for t in terms.tolist() if weights[t] and begins[t] < begins[t + 1]]
                    if lists:
                        at, scores, _ = nra(lists, len(ids), k, best.floor(q))
                        best.add(q, ids[at], scores, null[at])
        yield from best.batches()
        release()

    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return own.select("doc_id", "n", "doc", "term", "tf").mapInArrow(run, RANKED).withColumn("rank", rank).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = 50, most_terms: int = 200_000) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents (doc_id, text) of each query (item_id, text) with a score above 0."""
    spark = queries.sparkSession
    own = written(queries.select("item_id", F.coalesce("text", F.lit("")).alias("text")), "queries")
    letters = own.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(1, -(-letters // (2 * most_terms)))  # a term and what follows it are two characters at least
    dealt = own.withColumn("group", F.pmod(F.xxhash64("item_id", "text", F.monotonically_increasing_id()), F.lit(groups)))
    out = []
    for group in range(groups):
        rows = dealt.where(F.col("group") == group).select("item_id", "text").collect()
        if rows:
            names = spark.createDataFrame([(n, r.item_id) for n, r in enumerate(rows)], own.select(F.lit(0).cast("int").alias("query"), "item_id").schema)
            out.append(_group(docs, [r.text for r in rows], k).join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, out) if out else own.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
     n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
     t AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
     q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
     p AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
     w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), t),
     s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms))))) AS BIGINT) AS score
           FROM q JOIN p USING (term) JOIN w USING (term) JOIN n USING (doc_id), t GROUP BY 1, 2)
SELECT item_id, rank, doc_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""
