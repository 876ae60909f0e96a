"""Registered queries of the training-data operators, and their oracles."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm.decontaminate import op2_decontaminate
from tessera.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from tessera.llm.license_scan import OP5_SQL, op5_license_scan
from tessera.llm.mixing import OP3_SQL, op3_mixing
from tessera.llm.near_dedup import OP10_SQL, op10_near_dedup
from tessera.llm.secrets_scan import op7_secret_scan
from tessera.llm.sharding import OP8_SQL, op8_sharding
from tessera.llm.suffix_dedup import OP4_SQL, op4_suffix_dedup
from tessera.llm.token_files import op9_token_files
from tessera.llm.toxicity import op6_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_decontaminate, op3_mixing, op4_suffix_dedup, op5_license_scan, op6_toxicity, op7_secret_scan, op8_sharding, op9_token_files, op10_near_dedup)
} | {"pipeline": corpus_pipeline.run}
ORACLES = {"op1_exact_dedup": OP1_SQL, "op3_mixing": OP3_SQL, "op4_suffix_dedup": OP4_SQL, "op5_license_scan": OP5_SQL, "op8_sharding": OP8_SQL, "op10_near_dedup": OP10_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
