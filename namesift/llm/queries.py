"""Registered queries of the subpackage and the SQL they agree with."""

from __future__ import annotations

from namesift.llm import collocations, decontamination, html, licenses, line_quality, lines, mixing, quality, repeats, runs, sharding, simhash, toxicity

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_html_extraction": html.op2_html_extraction,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_repeated_passages": repeats.op4_repeated_passages,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_sharding": sharding.op6_sharding,
    "op7_line_first_quality": quality.op7_line_first_quality,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_line_quality": line_quality.op11_line_quality,
    "op12_collocations": collocations.op12_collocations,
    "op13_periodic_runs": runs.op13_periodic_runs,
}

ORACLES = {
    "op6_sharding": sharding.ORACLE,
    "op7_line_first_quality": quality.ORACLE,
    "op8_line_dedup": lines.ORACLE,
}
