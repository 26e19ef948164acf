"""Queries of the corpus operators, by name, and the SQL they are held against where SQL can express them."""

from __future__ import annotations

from biblioflow.llm import audit, lexical, secrets, topk
from biblioflow.llm.audit import op12_filter_audit
from biblioflow.llm.decontaminate import op7_decontaminate
from biblioflow.llm.idfile import op4_token_ids
from biblioflow.llm.language import op10_language_id
from biblioflow.llm.lexical import op11_lexical_search
from biblioflow.llm.pieces import op6_sentencepiece
from biblioflow.llm.repeats import op9_substring_dedup
from biblioflow.llm.secrets import op3_secret_scan
from biblioflow.llm.simhash import op5_simhash_neardup
from biblioflow.llm.sketches import op2_document_fingerprints
from biblioflow.llm.topk import op13_exact_topk
from biblioflow.llm.toxicity import op8_toxicity
from biblioflow.llm.warc import op1_warc_roundtrip

QUERIES = {
    "op1_warc_roundtrip": op1_warc_roundtrip,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_secret_scan": op3_secret_scan,
    "op4_token_ids": op4_token_ids,
    "op5_simhash_neardup": op5_simhash_neardup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_decontaminate": op7_decontaminate,
    "op8_toxicity": op8_toxicity,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_language_id": op10_language_id,
    "op11_lexical_search": op11_lexical_search,
    "op12_filter_audit": op12_filter_audit,
    "op13_exact_topk": op13_exact_topk,
}

ORACLE_SQL: dict[str, str] = {
    "op3_secret_scan": secrets.ORACLE,
    "op11_lexical_search": lexical.ORACLE,
    "op12_filter_audit": audit.ORACLE,
    "op13_exact_topk": topk.ORACLE,
}
