"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from . import bpe, codes, decontaminate, exact_dedup, html, language, licenses, negatives, secrets, simhash, toxicity, urls, warc

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_language": language.op2_language,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_warc": warc.op4_warc,
    "op5_simhash": simhash.op5_simhash,
    "op6_licenses": licenses.op6_licenses,
    "op7_html": html.op7_html,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_bpe": bpe.op9_bpe,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_urls": urls.op11_urls,
    "op12_negatives": negatives.op12_negatives,
    "op13_vector_codes": codes.op13_vector_codes,
}

SQL = {
    "op4_warc": warc.SQL,
    "op6_licenses": licenses.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_urls": urls.SQL,
    "op12_negatives": negatives.SQL,
    "op13_vector_codes": codes.SQL,
}
