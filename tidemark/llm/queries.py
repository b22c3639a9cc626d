"""The subpackage's queries, by the names that the driver uses, and their SQL."""

from __future__ import annotations

from . import bloom_cascade, bpe, hnsw, license_scan, minhash, packing, quality_classifier, quality_rules, simple8b, suffix_dedup
from .oracles import ORACLES

QUERIES = {
    "op1_quality_classifier": quality_classifier.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_packing": packing.query,
    "op4_embedding_dedup": hnsw.query,
    "op5_minhash": minhash.query,
    "op6_bpe": bpe.query,
    "op7_url_filter": bloom_cascade.query,
    "op8_quality_rules": quality_rules.query,
    "op9_token_files": simple8b.query,
    "op10_license_scan": license_scan.query,
}

__all__ = ["ORACLES", "QUERIES"]
