import hashlib

import numpy as np
import public_tokenizers

import corpus_pipeline
from tracelink.llm import bpe, mixing, simhash, toxicity


def groups(texts):
    """Place of the first text of each text's group: SimHash of five words within 6 bits, or 0.8 of all distinct five-word shingles shared."""
    fps = np.array([simhash.fingerprint(t.encode(), 5) for t in texts], np.uint64)
    sets = [set(shingles(t)) for t in texts]
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 6
    for i, a in enumerate(sets):
        for j in range(i):
            if a and min(len(a), len(sets[j])) >= 0.8 * max(len(a), len(sets[j])) and (both := len(a & sets[j])) >= 0.8 * (len(a) + len(sets[j]) - both):
                near[i, j] = near[j, i] = True
    own, todo = np.arange(len(texts)), True
    while todo:
        new = np.where(near, own[None, :], len(texts)).min(axis=1)
        todo, own = bool((new != own).any()), new
    return own


def shingles(text):
    words = text.lower().split()
    return [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def test_near_copies_against_brute_force(spark):
    """Texts whose copies differ in a few words at 0.8 or more, some of them only through the text they come from; other texts stay."""
    rng = np.random.default_rng(8)
    vocabulary = [f"word{i}" for i in range(3000)]
    texts = []
    for n in range(40):
        base = rng.choice(vocabulary, 300).tolist()
        for changes in rng.integers(1, 7, 5) if n < 30 else (40, 60):
            copy = list(base)
            for at in rng.choice(300, changes, replace=False):
                copy[at] = "changed" + str(rng.integers(1 << 30))
            texts.append(" ".join(copy))
        texts.append(" ".join(base))
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in simhash.first_of_each(docs).collect()}
    own = groups(texts)
    want = set(own.tolist())
    fps = np.array([simhash.fingerprint(t.encode(), 5) for t in texts], np.uint64)
    assert want <= kept  # nothing is dropped that brute force keeps
    pairs = len(texts) - len(want)
    assert len(kept) - len(want) <= 0.05 * pairs and pairs > 100
    alone = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 6
    assert alone.sum() - len(texts) < 2 * pairs  # SimHash alone would miss most


def test_stages(spark):
    """Each stage against its own decision taken by plain Python."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, sf).cache()
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    assert {r.doc_id for r in clean.collect()} == set(rows) - rejected and clean.columns == docs.columns

    single = corpus_pipeline.drop_near_copies(spark, clean, sf).cache()
    ids = sorted(r.doc_id for r in clean.collect())
    own = groups([rows[i].text for i in ids])
    assert sorted(r.doc_id for r in single.collect()) == sorted({ids[i] for i in own}) and single.columns == docs.columns

    mixed = corpus_pipeline.mix_sources(spark, single, sf).cache()
    chosen = {r.doc_id for r in mixing.mix(single).where("selected").collect()}
    assert {r.doc_id for r in mixed.collect()} == chosen and mixed.columns == docs.columns and 0 < len(chosen) < single.count()

    coder = bpe.Bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    got = {r.doc_id: r for r in corpus_pipeline.encode(spark, mixed, sf).collect()}
    assert set(got) == chosen
    for i in chosen:
        assert got[i].ids_sha256 == hashlib.sha256(np.array(coder.plain.encode_ordinary(rows[i].text), "<u4").tobytes()).hexdigest()


def test_repeated_and_missing_ids(spark):
    rows = [(1, "same words in both of these", "en", "s", 5), (2, "same words in both of these", "en", "s", 5), (3, "other things stand here alone now", "en", "s", 6), (3, "other things stand here alone now", "en", "s", 6), (None, None, None, None, None), (None, "a third text of its own is here", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "3", "None", "None"]
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_whole_run_with_clashing_columns_and_empty_tables(spark, tmp_path):
    """Columns with the names that stages use pass through unchanged, repeated and missing ids and all; nothing in, nothing out."""
    names = "doc_id long, text string, lang string, source string, n_chars long, topic string, weight string, selected string, probability string, node string, fp string, score string, mix_topic string, component string"
    rows = [(i if i % 7 else None, f"words of the text {i} stand here and number {i * 7} follows them" if i % 5 else None, "en" if i % 3 else None, f"s{i % 2}", i, *(["own"] * 9)) for i in range(60)]
    docs = spark.createDataFrame(rows + rows[:3], names)
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1, 30)] + [(None, 1), (4, None)], "doc_id long, toxic int")
    for n, table in enumerate((docs, docs.limit(0))):
        at = f"{tmp_path}/{n}"
        table.write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        own = spark.read.parquet(f"{at}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            own = stage(spark, own, at)
            assert own.columns == docs.columns
            assert all(set(r[5:]) == {"own"} for r in own.collect())
        got = corpus_pipeline.run(spark, at).collect()
        assert (len(got) > 10) == (n == 0) and len({r.doc_id for r in got if r.doc_id is not None}) == sum(r.doc_id is not None for r in got)
