"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import codes, divergence
from .codes import op13_hamerly_codes
from .credentials import op10_ownership_secrets
from .divergence import op12_source_divergence
from .langid import op3_crf_language_id
from .lm import op2_logbilinear_lm
from .media import op6_media_tiles
from .minhash import op1_superminhash_dedup
from .packing import op8_min_slack_packing
from .quality import op9_ngram_ratio_quality
from .segmentation import op7_sampled_segmentation
from .sharding import op4_size_tiered_sharding
from .simhash import op11_simhash_groups
from .substrings import op5_fingerprint_substring_dedup


def queries() -> dict:
    every = [
        op1_superminhash_dedup,
        op2_logbilinear_lm,
        op3_crf_language_id,
        op4_size_tiered_sharding,
        op5_fingerprint_substring_dedup,
        op6_media_tiles,
        op7_sampled_segmentation,
        op8_min_slack_packing,
        op9_ngram_ratio_quality,
        op10_ownership_secrets,
        op11_simhash_groups,
        op12_source_divergence,
        op13_hamerly_codes,
    ]
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """Only where SQL can express the whole result; the others are tested in tests/llm."""
    return {
        "op12_source_divergence": divergence.ORACLE_SQL,
        "op13_hamerly_codes": codes.ORACLE_SQL,
        "op4_size_tiered_sharding": "SELECT doc_id, lang, source, n_chars, strlen(text) AS n_bytes, md5(text) AS text_md5, TRUE AS sharded FROM documents",
    }
