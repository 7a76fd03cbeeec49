"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, exact_dedup, html_extract, lattice, line_dedup, near_dedup, packing, quality, toxicity, warc

QUERIES = {
    "op1_quality_classifier": quality.query,
    "op2_line_dedup": line_dedup.query,
    "op3_warc": warc.query,
    "op4_benchmark_decontamination": decontaminate.query,
    "op5_best_fit_packing": packing.query,
    "op6_html_extraction": html_extract.query,
    "op7_minhash_near_dedup": near_dedup.query,
    "op8_lattice_scoring": lattice.query,
    "op9_toxicity": toxicity.query,
    "op10_exact_dedup": exact_dedup.query,
}
#: The others need a tokenizer, a trained model, files or an iteration, which SQL lacks; tests/llm holds them against brute force.
ORACLE = {
    "op2_line_dedup": line_dedup.ORACLE_SQL,
    "op3_warc": warc.ORACLE_SQL,
    "op10_exact_dedup": exact_dedup.ORACLE_SQL,
}
