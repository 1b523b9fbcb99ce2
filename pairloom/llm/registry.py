"""The queries of the corpus operators, and their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from . import decontam, exact_dedup, license_scan, minhash, mixing, pii, quality, secrets, token_output, url_filter

QUERIES = {
    "op1_token_output": token_output.op1_token_output,
    "op2_pii": pii.op2_pii,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_mixing": mixing.op6_mixing,
    "op7_quality_nbsvm": quality.op7_quality_nbsvm,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_decontam": decontam.op9_decontam,
    "op10_minhash": minhash.op10_minhash,
}
ORACLE: dict = {
    "op2_pii": pii.OP2_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op4_license_scan": license_scan.OP4_SQL,
    "op5_secret_scan": secrets.OP5_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op8_url_filter": url_filter.OP8_SQL,
    "op10_minhash": minhash.OP10_SQL,
}
