"""Every query against a plain version, on the smallest tables and on edge cases; and on empty tables."""

from __future__ import annotations

import pandas as pd
import pytest

from lodestar.llm.queries import ORACLES, QUERIES
from tests.llm import brute


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    done: dict = {}

    def get(name: str, folder: str = sf_dir) -> pd.DataFrame:
        if (name, folder) not in done:
            done[name, folder] = QUERIES[name](spark, folder).toPandas()
        return done[name, folder]

    return get


@pytest.fixture(scope="module")
def docs(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", QUERIES)
def test_empty(name, results, empty_dir):
    assert len(results(name, empty_dir)) == 0


@pytest.mark.parametrize("name", ORACLES)
def test_sql(name, spark, sf_dir):
    from tests.oracle import compare

    assert compare(spark, sf_dir, QUERIES[name], ORACLES[name]) == ""


@pytest.mark.parametrize("name", ORACLES)
def test_sql_edges(name, spark, edge_dir, tmp_path):
    """Nulls, empty texts, copies and other scripts; DuckDB reads a table's files under one name."""
    from tests.oracle import compare

    for t in ("documents", "pages"):
        spark.read.parquet(f"{edge_dir}/{t}.parquet").toPandas().convert_dtypes().to_parquet(str(tmp_path / f"{t}.parquet"))
    assert compare(spark, str(tmp_path), QUERIES[name], ORACLES[name]) == ""


EXACT = {"op1_suffix_dedup": brute.suffix_dedup, "op4_matroska": brute.payloads, "op5_bpe_chunks": brute.encoded, "op10_secret_scan": brute.secrets}


@pytest.mark.parametrize("name", EXACT)
def test_exact(name, results, docs):
    brute.same(results(name), EXACT[name](docs))


@pytest.mark.parametrize("name", EXACT)
def test_exact_edges(name, results, edge_docs, edge_dir):
    brute.same(results(name, edge_dir), EXACT[name](edge_docs))


def test_remaining_texts(results, edge_docs, edge_dir):
    """The text that is left has the digest's bytes, but for characters that were cut in part."""
    import hashlib

    got = results("op1_suffix_dedup", edge_dir)
    ascii_ = got[got["text"].notna() & got["text"].fillna("").map(str.isascii)]
    assert len(ascii_) > 10 and all(hashlib.sha256(t.encode()).hexdigest() == h for t, h in zip(ascii_["text"], ascii_["kept_sha256"], strict=True))
    assert (got["text"].fillna("").map(lambda t: len(t.encode())) <= got["n_bytes"] - got["n_removed"]).all()


def test_near_duplicates(results, docs):
    brute.same(results("op6_chosen_path"), brute.near_duplicates(docs))


def test_near_duplicates_edges(results, edge_docs, edge_dir):
    known = edge_docs[edge_docs["doc_id"].notna()]
    got = results("op6_chosen_path", edge_dir)
    brute.same(got[got["doc_id"].notna()], brute.near_duplicates(known))
    assert len(got) == len(edge_docs)
    base = got[got["doc_id"].isna() & (got["n_shingles"] > 0)]
    assert base["component_id"].tolist() == [6]  # a row without an id joins the component of its copies


def test_packing(results, docs):
    assert brute.check_packing(docs, results("op2_packing")) < 0.02


def test_packing_edges(results, edge_docs, edge_dir):
    got = results("op2_packing", edge_dir).astype({"doc_id": "Int64"})
    brute.check_packing(edge_docs.fillna({"doc_id": -1}), got.fillna({"doc_id": -1}))


def test_packing_keeps_large_ids(spark):
    from lodestar.llm import packing
    from lodestar.llm.common import prepare

    docs = prepare(spark).createDataFrame([((1 << 60) + 1, "some words"), (None, "others"), (None, None)], "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in packing.pack(docs).collect()) == [0, 0, (1 << 60) + 1]


def test_warc(results, sf_dir):
    brute.same(results("op8_warc_zstd"), brute.warc(pd.read_parquet(f"{sf_dir}/pages.parquet")), "page_id")


def test_warc_edges(results, edge_dir):
    brute.same(results("op8_warc_zstd", edge_dir), brute.warc(pd.read_parquet(f"{edge_dir}/pages.parquet")), "page_id")


def test_fingerprints(results, docs):
    got = results("op9_fingerprints").merge(brute.edits(docs), on="doc_id", suffixes=("", "_exact"))
    assert len(got) == len(docs)
    assert (got["n_chars"] == got["n_chars_exact"]).all() and (got["edited_sha256"] == got["edited_sha256_exact"]).all()
    assert (got["near_edited"] - got["near_edited_exact"]).abs().mean() < 0.05
    assert (got["near_next"] - got["near_next_exact"]).abs().max() < 0.2


def test_fingerprints_edges(results, edge_docs, edge_dir):
    got = results("op9_fingerprints", edge_dir)
    assert len(got) == len(edge_docs)
    prints = got[got["doc_id"].isin([6, 7])]["fingerprint"]
    assert prints.nunique() == 1  # copies have equal fingerprints


def test_language(results, docs):
    got = results("op7_language_id").merge(docs, on="doc_id")
    held = got[got["held_out"] & got["lang"].notna()]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_language_edges(results, edge_docs, edge_dir):
    got = results("op7_language_id", edge_dir)
    assert len(got) == len(edge_docs)
    assert (got[got["doc_id"].isin([0, 1, 2])]["lang_pred"] == "und").all()


def test_toxicity(results, docs, edge_dir, edge_docs):
    for got, n in ((results("op3_toxicity"), len(docs)), (results("op3_toxicity", edge_dir), len(edge_docs))):
        assert len(got) == n and got["score"].between(0, 1).all()
        assert (got["predicted"] == (got["score"] >= 0.5)).all()


def test_toxicity_learns(spark, tmp_path):
    """Held-out documents with planted toxic passages score high, clean ones low."""
    import random

    from tests.llm.conftest import COLUMNS, prose

    r, rows, labels = random.Random(5), [], []
    for i in range(900):
        toxic = i % 3 == 0
        words = prose(80, 100 + i).split()
        if toxic:
            words[40:40] = [f"vile{r.randrange(12)}" for _ in range(9)]
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = QUERIES["op3_toxicity"](spark, str(tmp_path)).toPandas()
    held = got[got["held_out"]]
    assert ((held["doc_id"] % 3 == 0) == (held["predicted"] == 1)).mean() > 0.97


@pytest.fixture(scope="module")
def long_docs():
    from tests.llm.conftest import prose

    texts = [prose(300_000, 21), "x" * 700_000, "\u00e9t\u00e9 " * 150_000, "token=" + "a1B2" * 60_000 + " " + "0123456789abcdef" * 20_000, "short one", None]
    return pd.DataFrame({"doc_id": pd.array(range(len(texts)), dtype="Int64"), "text": texts, "lang": ["en", None, "fr", None, "en", "fr"]})


@pytest.fixture(scope="module")
def long_dir(spark, long_docs, tmp_path_factory):
    top = tmp_path_factory.mktemp("long")
    rows = [(int(i), t, lang, "s", None) for i, t, lang in long_docs.itertuples(index=False)]
    from tests.llm.conftest import COLUMNS

    spark.createDataFrame(rows, COLUMNS).repartition(2).write.parquet(str(top / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, r[0] % 2) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(top / "labels.parquet"))
    spark.createDataFrame([(r[0], None, r[1]) for r in rows], "page_id long, url string, html string").write.parquet(str(top / "pages.parquet"))
    return str(top)


@pytest.mark.parametrize("name", QUERIES)
def test_very_long_texts(name, results, long_docs, long_dir):
    """Texts of megabytes, with and without white space, are treated whole."""
    got = results(name, long_dir)
    if name == "op2_packing":
        assert brute.check_packing(long_docs, got) < 0.02
    elif name == "op8_warc_zstd":
        brute.same(got, brute.warc(pd.read_parquet(f"{long_dir}/pages.parquet")), "page_id")
    elif name in EXACT:
        brute.same(got, EXACT[name](long_docs))
    elif name == "op6_chosen_path":
        brute.same(got, brute.near_duplicates(long_docs))
    else:
        assert sorted(got["doc_id"]) == list(range(len(long_docs)))
        assert not got.isna().drop(columns=[c for c in ("lang_pred",) if c in got]).any().any()
