import zlib

import numpy as np
import pandas as pd
from test_documents import ODD, docs

import corpus_pipeline
from compare import SF
from tessera.llm import toxicity


def test_held_out_accuracy(spark):
    """The bounded sample that the query fits on, each language by itself."""
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{x}.parquet") for x in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = docs.join(labels, "doc_id").select("doc_id", "lang", "text", "toxic").orderBy("doc_id").toPandas()
    out = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id])
    y, flagged = rows.toxic.to_numpy(), model.scores([toxicity.word_hashes(x.encode()) for x in rows.text]) >= 0.5
    for lang in ("en", "fr", "de", "es"):
        own = out & (rows.lang == lang).to_numpy()
        assert flagged[own & (y == 0)].mean() <= 0.05 and flagged[own & (y == 1)].mean() >= 0.8, lang
        share = flagged[(rows.lang == lang)].mean()
        assert share <= 2 * y[rows.lang == lang].mean(), lang
    assert model.scores([toxicity.word_hashes(b""), toxicity.word_hashes(b" 12 ")]).max() < 0.1
    # the sample's order in the table does not matter
    again = toxicity.fit(docs.orderBy("text").repartition(3), labels)
    assert np.array_equal(again.thresholds, model.thresholds) and np.array_equal(again.table, model.table)


def test_few_labels_fall_back_on_all_languages(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{x}.parquet") for x in ("documents", "labels"))
    got = toxicity.score_documents(docs, labels).join(docs.select("doc_id", "lang"), "doc_id").join(labels, "doc_id").toPandas()
    for lang in ("en", "fr", "de", "es"):
        own = got[got.lang == lang]
        assert own.predicted.mean() <= 2 * max(own.toxic.mean(), 0.06), lang
        assert own[own.toxic == 0].predicted.mean() <= 0.06, lang


def test_thresholds_of_few_rows_stay_near_the_common_one():
    rng = np.random.default_rng(2)
    y = np.repeat([0, 1], [4000, 400])
    z, language = rng.normal(4.0 * y - 2, 0.5), np.ones(4400, np.int64)
    few = np.array([-6.0, -5.5, 7.0, 0.1, 0.2]), np.array([1, 1, 1, 0, 0])
    found = toxicity.thresholds(np.append(z, few[0]), np.append(y, few[1]), np.append(language, [4] * 5))
    assert abs(found[4] - found[1]) < 1 and (found == toxicity.thresholds(np.append(z, few[0]), np.append(y, few[1]), np.append(language, [4] * 5))).all()
    assert (toxicity.thresholds(z, np.zeros(4400, np.int64), language) == 0).all()


def test_long_texts_are_cut_without_loss(monkeypatch):
    rng = np.random.default_rng(0)
    bad = [b"w%d" % rng.integers(200) for _ in range(3000)]
    texts = [toxicity.word_hashes(b" ".join(bad[k : k + 40]) + (b" wretch" if k % 2 else b"")) for k in range(200)]
    model = toxicity.train(texts, np.arange(200) % 2, epochs=3)
    longest = [toxicity.word_hashes(b" ".join(bad + [b"wretch"] + bad)), toxicity.word_hashes(b" ".join(bad)), toxicity.word_hashes(b"")]
    whole = model.scores(longest)
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", 7)
    assert np.allclose(model.scores(longest), whole, atol=1e-6) and whole[0] > whole[1]


def test_words_and_their_beginnings():
    found = toxicity.word_hashes("Ab, abcdefgh abcdxy éé".encode())
    assert found.shape == (4, 3) and (found[0] == found[0, 0]).all() and found[1, 1] == found[2, 1] and found[2, 2] == found[2, 0] != found[1, 2]


def test_odd_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.score_documents(docs(spark), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert max(r.score for r in toxicity.score_documents(docs(spark), labels.limit(0)).collect()) < 0.06
    assert all(r.score < 0.1 for r in got if r.doc_id in (2, 3, 4))
    assert toxicity.score_documents(docs(spark, []), labels).count() == 0
    assert set(toxicity.clean_documents(docs(spark), labels).columns) == set(docs(spark).columns)


def test_pipeline(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    kept = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == table.columns
        ids, were = {r.doc_id for r in kept.select("doc_id").collect()}, {r.doc_id for r in before.select("doc_id").collect()}
        assert ids <= were and (name in ("toxicity", "near_dedup") or ids == were)
    packed = stages["packing"](spark, kept, SF).collect()
    assert sum(r.piece == 0 for r in packed) == kept.count()
    assert corpus_pipeline.run(spark, SF).count() == len(packed)
