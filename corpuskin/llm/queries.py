"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from corpuskin.llm import decontaminate, langid, licenses, packing, repeats, secrets, sharding, simhash, toxicity, vectors

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_embedding_near_dedup": vectors.op3_embedding_near_dedup,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_benchmark_decontamination": decontaminate.op6_benchmark_decontamination,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_language_id": langid.op8_language_id,
    "op9_repeated_passages": repeats.op9_repeated_passages,
    "op10_rendezvous_sharding": sharding.op10_rendezvous_sharding,
}

ORACLE_SQL = {
    "op2_secret_scan": secrets.ORACLE_OP2,
    "op3_embedding_near_dedup": vectors.ORACLE_OP3,
    "op5_license_scan": licenses.ORACLE_OP5,
    "op6_benchmark_decontamination": decontaminate.ORACLE_OP6,
    "op9_repeated_passages": repeats.ORACLE_OP9,
    "op10_rendezvous_sharding": sharding.ORACLE_OP10,
}
