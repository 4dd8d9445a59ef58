"""The operators' queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from ecorisk.llm import decontamination, exact_dedup, language_id, near_dedup, packing, secret_scan, substring_dedup, token_store, toxicity, warc
from ecorisk.llm.sql import LEAKS_SQL, NEAR_SQL, SECRETS_SQL, SUBSTRING_SQL

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_minhash_near_dedup": near_dedup.op2,
    "op3_warc": warc.op3,
    "op4_secret_scan": secret_scan.op4,
    "op5_packing": packing.op5,
    "op6_token_ids": token_store.op6,
    "op7_exact_dedup": exact_dedup.op7,
    "op8_substring_dedup": substring_dedup.op8,
    "op9_benchmark_decontamination": decontamination.op9,
    "op10_language_id": language_id.op10,
}
ORACLE_SQL = {
    "op2_minhash_near_dedup": NEAR_SQL,
    "op3_warc": warc.OP3_SQL,
    "op4_secret_scan": SECRETS_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op8_substring_dedup": SUBSTRING_SQL,
    "op9_benchmark_decontamination": LEAKS_SQL,
}
