"""The registered queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from . import byte_bpe, decontamination, factorisation, license_scan, minhash_dedup, pii, preference_chat, quality_rules, sharding, token_counts

QUERIES = {
    "op1_factorisation": factorisation.op1_factorisation,
    "op2_preference_chat": preference_chat.op2_preference_chat,
    "op3_sharding": sharding.op3_sharding,
    "op4_minhash_dedup": minhash_dedup.op4_minhash_dedup,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
    "op10_pii": pii.op10_pii,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op2_preference_chat": preference_chat.OP2_SQL,
    "op6_decontamination": decontamination.OP6_SQL,
    "op8_quality_rules": quality_rules.OP8_SQL,
    "op10_pii": pii.OP10_SQL,
}
