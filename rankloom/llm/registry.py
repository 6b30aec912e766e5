"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from rankloom.llm.alignment import op11_alignment
from rankloom.llm.bpe import op9_bpe
from rankloom.llm.clustered_index import OP13_SQL, op13_ranked_search
from rankloom.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from rankloom.llm.html_text import op4_main_text
from rankloom.llm.langid import op1_language
from rankloom.llm.mixing import OP6_SQL, op6_mix_sources
from rankloom.llm.pii import op10_personal_data
from rankloom.llm.quality import op3_quality
from rankloom.llm.repeats import OP12_SQL, op12_repeats
from rankloom.llm.simhash import op2_simhash
from rankloom.llm.token_files import op8_token_files
from rankloom.llm.topk import OP7_SQL, op7_top_k

QUERIES = {
    "op1_language": op1_language,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_main_text": op4_main_text,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_mix_sources": op6_mix_sources,
    "op7_top_k": op7_top_k,
    "op8_token_files": op8_token_files,
    "op9_bpe": op9_bpe,
    "op10_personal_data": op10_personal_data,
    "op11_alignment": op11_alignment,
    "op12_repeats": op12_repeats,
    "op13_ranked_search": op13_ranked_search,
}
ORACLE_SQL = {
    "op5_exact_dedup": OP5_SQL,
    "op6_mix_sources": OP6_SQL,
    "op7_top_k": OP7_SQL,
    "op12_repeats": OP12_SQL,
    "op13_ranked_search": OP13_SQL,
}
