"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from cinderlog.llm.alignment import op12_alignment
from cinderlog.llm.ann import op7_ann
from cinderlog.llm.conversations import op11_conversations
from cinderlog.llm.decontamination import OP5_SQL, op5_decontamination
from cinderlog.llm.html_text import op9_html
from cinderlog.llm.language import op4_language
from cinderlog.llm.line_dedup import op6_line_dedup
from cinderlog.llm.minhash import OP8_SQL, op8_minhash
from cinderlog.llm.packing import op1_packing
from cinderlog.llm.quality import op10_quality
from cinderlog.llm.secrets import op3_secrets
from cinderlog.llm.sharding import op13_sharding
from cinderlog.llm.token_counts import op2_token_counts

LLM_QUERIES = {
    f.__name__: f for f in (op1_packing, op2_token_counts, op3_secrets, op4_language, op5_decontamination, op6_line_dedup, op7_ann, op8_minhash, op9_html, op10_quality, op11_conversations, op12_alignment, op13_sharding)
}
LLM_ORACLES = {"op5_decontamination": OP5_SQL, "op8_minhash": OP8_SQL}
