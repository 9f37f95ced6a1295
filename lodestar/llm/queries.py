"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from lodestar.llm import bpe_chunks, chosen_path, fingerprints, language_id, matroska, oracles, packing, secrets, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1,
    "op2_packing": packing.op2,
    "op3_toxicity": toxicity.op3,
    "op4_matroska": matroska.op4,
    "op5_bpe_chunks": bpe_chunks.op5,
    "op6_chosen_path": chosen_path.op6,
    "op7_language_id": language_id.op7,
    "op8_warc_zstd": warc.op8,
    "op9_fingerprints": fingerprints.op9,
    "op10_secret_scan": secrets.op10,
}
ORACLES: dict[str, str] = {
    "op1_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op6_chosen_path": oracles.CHOSEN_PATH,
    "op8_warc_zstd": oracles.WARC,
}
