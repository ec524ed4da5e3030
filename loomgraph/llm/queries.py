"""Registered queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import exact_topk, lexical_rank, merkle, phrase_index
from .exact_topk import op12_exact_topk
from .language_id import op5_language_fusion, pages_language
from .lexical_rank import op13_lexical_rank
from .line_templates import op7_line_templates
from .merkle import op11_merkle_manifest
from .packing import op2_vector_packing
from .passage_chains import op1_passage_chains
from .phrase_index import op9_phrase_index
from .secret_scan import op10_credential_links
from .simhash import op4_simhash_pigeonhole
from .telephony import op3_telephony_audio
from .toxicity import op8_text_cnn
from .url_filter import op6_url_lm_ratio

QUERIES = {
    "op1_passage_chains": op1_passage_chains,
    "op2_vector_packing": op2_vector_packing,
    "op3_telephony_audio": op3_telephony_audio,
    "op4_simhash_pigeonhole": op4_simhash_pigeonhole,
    "op5_language_fusion": op5_language_fusion,
    "pages_language": pages_language,
    "op6_url_lm_ratio": op6_url_lm_ratio,
    "op7_line_templates": op7_line_templates,
    "op8_text_cnn": op8_text_cnn,
    "op9_phrase_index": op9_phrase_index,
    "op10_credential_links": op10_credential_links,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_exact_topk": op12_exact_topk,
    "op13_lexical_rank": op13_lexical_rank,
}

ORACLES: dict[str, str] = {
    "op9_phrase_index": phrase_index.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_exact_topk": exact_topk.ORACLE,
    "op13_lexical_rank": lexical_rank.ORACLE,
}
