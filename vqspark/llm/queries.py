"""The subpackage's queries and their SQL, for the entry module."""

from . import alignment, bpe, decontamination, fingerprints, licenses, near_dups, pii, quality, repeats, resampling, sharding, topk, toxicity

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_near_duplicates": near_dups.op2_near_duplicates,
    "op3_bpe": bpe.op3_bpe,
    "op4_licenses": licenses.op4_licenses,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality": quality.op6_quality,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_fingerprints": fingerprints.op8_fingerprints,
    "op9_personal_data": pii.op9_personal_data,
    "op10_repeats": repeats.op10_repeats,
    "op11_alignment": alignment.op11_alignment,
    "op12_resampling": resampling.op12_resampling,
    "op13_topk": topk.op13_topk,
}

ORACLE_SQL = {
    "op1_sharding": sharding.OP1_SQL,
    "op2_near_duplicates": near_dups.OP2_SQL,
    "op4_licenses": licenses.OP4_SQL,
    "op7_decontamination": decontamination.OP7_SQL,
    "op12_resampling": resampling.OP12_SQL,
    "op13_topk": topk.OP13_SQL,
}
