"""The queries of this subpackage, and their SQL where there is one."""

from . import hnsw, html_extraction, language_id, lm_scoring, merkle, mixing, packing, repair, secrets, simhash, suffix_dedup, topk, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_lm_scoring": lm_scoring.op2_lm_scoring,
    "op3_topk": topk.op3_topk,
    "op4_simhash": simhash.op4_simhash,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_hnsw": hnsw.op6_hnsw,
    "op7_secrets": secrets.op7_secrets,
    "op8_language_id": language_id.op8_language_id,
    "op9_packing": packing.op9_packing,
    "op10_html_extraction": html_extraction.op10_html_extraction,
    "op11_suffix_dedup": suffix_dedup.op11_suffix_dedup,
    "op12_repair": repair.op12_repair,
    "op13_merkle": merkle.op13_merkle,
}

ORACLES = {"op3_topk": topk.OP3_SQL, "op7_secrets": secrets.OP7_SQL, "op11_suffix_dedup": suffix_dedup.OP11_SQL, "op12_repair": repair.OP12_SQL, "op13_merkle": merkle.OP13_SQL}
