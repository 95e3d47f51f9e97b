import duckdb
import pytest
from pyspark.sql import functions as F

from tracelink.llm import mixing


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    assert rows_of(mixing.op10_mixing(spark, f"/root/testdata/{sf}")) == sorted(map(str, con.execute(mixing.OP10_SQL).fetchall()))


def test_margins_meet_targets(spark):
    """Expected kept tokens meet the targets of all margins, and so do the drawn ones, within the draw's own spread."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    p, goals = mixing.fitted(docs, 0.7, 0.7, 30, 12, None, mixing.TOPICS, None)
    p = p.cache()
    total = p.agg(F.sum("w")).first()[0]
    tokens = p.agg(F.sum("tokens")).first()[0]
    assert total == pytest.approx(0.7 * tokens, rel=1e-4) and p.where("p > 1 OR p < 0").count() == 0
    rows = mixing.residuals(p, goals).collect()
    assert {r.margin for r in rows} == {"mix_source", "mix_lang", "mix_topic"}
    assert all(abs(r.expected - r.target) < 1e-4 * total for r in rows)
    words = F.regexp_count("text", F.lit(mixing.WORD))
    drawn = mixing.mix(docs).where("selected").withColumn("n", words)
    for margin, column in (("mix_source", "source"), ("mix_lang", "lang"), ("mix_topic", "topic")):
        got = {r[0]: r for r in drawn.groupBy(column).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2")).collect()}
        for r in rows:
            if r.margin == margin and r.target > 0:
                own = got[r.value]
                assert abs(own.n - r.target) < 5 * own.n2**0.5 + 1e-3 * total


def test_given_targets_and_topics(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = spark.createDataFrame([("en", 0.4), ("de", 0.2), ("fr", 0.2), ("es", 0.2)], "mix_lang string, target double")
    kinds = F.when(F.length("text") > 3000, "long").otherwise("short")
    p = mixing.probabilities(docs, keep=0.1, targets={"mix_lang": lang}, topics=kinds).cache()
    total = p.agg(F.sum("w")).first()[0]
    for r in p.groupBy("mix_lang").agg(F.sum("w").alias("w")).collect():
        assert r.w / total == pytest.approx({"en": 0.4}.get(r.mix_lang, 0.2), rel=1e-2)
    assert {r.mix_topic for r in p.collect()} == {"long", "short"}
    got = mixing.mix(docs, keep=0.1, targets={"mix_lang": lang}, topics=kinds)
    assert got.count() == docs.count() and {r[0] for r in got.select("topic").distinct().collect()} == {"long", "short"}


def test_edge_cases(spark):
    rows = [(1, "a b", None, "s", 1), (1, "a b", None, "s", 1), (None, "x @ y", "en", None, 2), (3, None, "en", "s", 3), (4, "", "xx", "only", 4), (5, "word " * 50_000, "en", "s", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, weight int")
    got = mixing.mix(df, keep=1.0)
    assert got.count() == len(rows) and got.where("selected").count() >= 4 and set(got.columns) == {"doc_id", "text", "lang", "source", "topic", "weight", "probability", "selected"}
    twice = [r.selected for r in mixing.mix(df, keep=0.5).where("doc_id = 1").collect()]
    assert twice[0] == twice[1]
    assert mixing.mix(df.limit(0)).count() == 0


def test_joined_alike_with_and_without_broadcast(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    few = rows_of(mixing.mix(docs, rounds=2).select("doc_id", "selected"))
    monkeypatch.setattr(mixing, "SMALL", 0)
    assert rows_of(mixing.mix(docs, rounds=2).select("doc_id", "selected")) == few
