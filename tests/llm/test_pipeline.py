"""The pipeline and its stages, each on its own input."""

from __future__ import annotations

import corpus_pipeline
from tests.llm import brute


def test_stages(spark, edge_dir, edge_docs, tmp_path):
    docs, texts = spark.read.parquet(f"{edge_dir}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, edge_dir).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == before.columns, name
            texts[name] = docs.toPandas()
    ids = texts["language id"]["doc_id"].dropna().tolist()
    assert not {0, 1, 2} & set(ids) and {3, 4, 5, 6, 7, 8} <= set(ids)
    ids = texts["near dedup"]["doc_id"].dropna().tolist()
    assert ids.count(6) == 1 and 7 not in ids and 8 not in ids and {3, 4, 5, 9, 10, 11} <= set(ids)
    kept = texts["near dedup"]
    want = brute.removed(kept["text"].tolist(), 200)
    got = texts["suffix dedup"].set_index("doc_id")["text"]
    for doc, text, spans in zip(kept["doc_id"], kept["text"], want, strict=True):
        if doc == doc and not spans:
            assert got[doc] == text
        elif doc == doc:
            assert len(got[doc].encode()) <= len(text.encode()) - sum(b - a for a, b in spans)
    clean = texts["secret scan"].set_index("doc_id")["text"][13]
    assert "hunter2" not in clean and "AKIA" not in clean and "[access]" in clean
    packed = docs.toPandas()
    brute.check_packing(texts["secret scan"].astype({"doc_id": "float"}).fillna({"doc_id": -1}), packed.astype({"doc_id": "float"}).fillna({"doc_id": -1}))


def test_run(spark, sf_dir, empty_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 100
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_near_stage_of_a_large_group(spark, monkeypatch, tmp_path):
    """Independent edits of one base go, however many they are."""
    from lodestar.llm import chosen_path
    from tests.llm.test_parts import edits

    monkeypatch.setattr(chosen_path, "LEAF", 120)
    docs = spark.createDataFrame(edits("star", 700, 4, 4), "doc_id long, text string").repartition(4)
    assert [r.doc_id for r in chosen_path.near_stage(spark, docs, "").select("doc_id").collect()] == [0]


def test_language_stage_without_languages(spark):
    """With no language to learn, only null texts and those without a letter go."""
    from lodestar.llm import language_id

    docs = spark.createDataFrame([(1, "some words", None), (2, None, None), (3, "12 !", None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in language_id.language_stage(spark, docs, "").collect()] == [1]


def test_private_keys_go_whole(spark):
    """The body of a key goes with its BEGIN line, with or without an END line; what follows and the next text stay."""
    from lodestar.llm import secrets

    body = ("QUJD" * 16 + "\n") * 3
    texts = [f"a\n-----BEGIN RSA PRIVATE KEY-----\n{body}QUI=\n-----END RSA PRIVATE KEY-----\nb", f"a\n-----BEGIN PRIVATE KEY-----\n{body}QUI=\nb", "-----BEGIN PRIVATE KEY-----\nNote: words", body]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long").coalesce(1)
    got = [r.text for r in secrets.redact_stage(spark, docs, "").orderBy("doc_id").collect()]
    assert got == ["a\n[private_key]\nb", "a\n[private_key]\nb", "[private_key]\nNote: words", body]


def test_near_stage_of_rows_that_share_an_id(spark):
    """Unlike texts with one id each count for themselves; of equal rows and of near copies one stays."""
    from lodestar.llm import chosen_path
    from tests.llm.conftest import prose

    a, b = prose(60, 1), prose(60, 2)
    near = a.rsplit(" ", 1)[0]
    docs = spark.createDataFrame([(5, a), (5, b), (5, b), (3, near), (7, ""), (7, None), (None, a)], "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in chosen_path.near_stage(spark, docs, "").collect()), key=str)
    assert got == sorted([(5, b), (3, near), (7, ""), (7, None), (None, a)], key=str)


def test_language_stage_rejects_what_no_language_claims(spark, sf_dir):
    """Gibberish and a language that is not learned go, prose of the learned languages stays."""
    import random
    import string

    from lodestar.llm import language_id

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    r = random.Random(3)
    junk = ["".join(r.choice(string.ascii_letters) for _ in range(800)), "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 9, "0123456789abcdef" * 40 + "qzx"]
    more = spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate(junk)], docs.schema)
    kept = {x.doc_id for x in language_id.language_stage(spark, docs.unionAll(more), "").collect()}
    real = {x.doc_id for x in docs.where("text IS NOT NULL AND lang IS NOT NULL").collect()}
    assert not kept & {10**9 + i for i in range(len(junk))}
    assert len(real - kept) <= 0.01 * len(real)


def test_near_stage_plain(spark, sf_dir):
    """Kept are the documents that a plain version keeps: the least id of each group."""
    import pandas as pd

    from lodestar.llm import chosen_path

    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    plain = brute.near_duplicates(docs, 5, 80)
    got = chosen_path.near_stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), "")
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(plain[plain["kept"]]["doc_id"].tolist())


def test_stored_tables_are_deleted(spark, sf_dir):
    """After a run only the last stage's input is left, and after the session nothing."""
    import os

    from lodestar.llm import common

    common.dropped(spark, 0)
    corpus_pipeline.run(spark, sf_dir).count()
    left = list(common.held(spark))
    assert len(left) == 1 and "stage-secret-scan" in left[0] and os.path.exists(left[0])
    common.dropped(spark, 0)
    assert not common.held(spark) and not os.path.exists(left[0])
