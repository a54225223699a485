"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from quern.llm import chat, hamming, quantize
from quern.llm.chat import op4_chat_format
from quern.llm.decontaminate import op7_decontamination
from quern.llm.hamming import op1_binary_top_k
from quern.llm.html import op6_html_extraction
from quern.llm.lm import op8_language_model
from quern.llm.neardup import op3_near_duplicates
from quern.llm.packing import op5_packing
from quern.llm.partenum import op11_jaccard_join
from quern.llm.periods import op12_periodic_runs
from quern.llm.quantize import op13_vector_codes
from quern.llm.secrets import op2_secret_scan
from quern.llm.tokens import op9_token_ids
from quern.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_binary_top_k": op1_binary_top_k,
    "op2_secret_scan": op2_secret_scan,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_chat_format": op4_chat_format,
    "op5_packing": op5_packing,
    "op6_html_extraction": op6_html_extraction,
    "op7_decontamination": op7_decontamination,
    "op8_language_model": op8_language_model,
    "op9_token_ids": op9_token_ids,
    "op10_toxicity": op10_toxicity,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES: dict[str, str] = {"op1_binary_top_k": hamming.ORACLE_SQL, "op4_chat_format": chat.ORACLE_SQL, "op13_vector_codes": quantize.ORACLE_SQL}
