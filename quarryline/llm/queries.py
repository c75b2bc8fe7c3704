"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import exactdedup, fingerprint, htmlextract, linededup, lm, mixing, packing, periodic, resampling, sharding, simhash, substring, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_packing": packing.op2_packing,
    "op3_simhash": simhash.op3_simhash,
    "op4_mixing": mixing.op4_mixing,
    "op5_fingerprints": fingerprint.op5_fingerprints,
    "op6_line_dedup": linededup.op6_line_dedup,
    "op7_substring_dedup": substring.op7_substring_dedup,
    "op8_lm_scoring": lm.op8_lm_scoring,
    "op9_sharding": sharding.op9_sharding,
    "op10_exact_dedup": exactdedup.op10_exact_dedup,
    "op11_html_extraction": htmlextract.op11_html_extraction,
    "op12_resampling": resampling.op12_resampling,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}
SQL = {
    "op6_line_dedup": linededup.SQL,
    "op10_exact_dedup": exactdedup.SQL,
    "op12_resampling": resampling.SQL,
}
