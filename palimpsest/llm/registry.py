"""Queries of the training-data operators and their DuckDB SQL."""

from palimpsest.llm.chat_format import OP3_SQL, op3_chat_format
from palimpsest.llm.code_compression import OP12_SQL, op12_vector_codes
from palimpsest.llm.decontaminate import op4_decontaminate
from palimpsest.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from palimpsest.llm.fingerprints import OP11_SQL, op11_fingerprints
from palimpsest.llm.near_dedup import op10_near_dedup
from palimpsest.llm.packing import op7_packing
from palimpsest.llm.quality import op6_quality
from palimpsest.llm.substring_dedup import op9_substring_dedup
from palimpsest.llm.suffix_dedup import op1_suffix_dedup
from palimpsest.llm.token_alignment import op13_token_alignment
from palimpsest.llm.token_counts import op8_token_counts
from palimpsest.llm.toxicity import op5_toxicity
from palimpsest.session import with_package

QUERIES = {
    "op1_suffix_dedup": with_package(op1_suffix_dedup),
    "op2_exact_dedup": op2_exact_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_decontaminate": with_package(op4_decontaminate),
    "op5_toxicity": with_package(op5_toxicity),
    "op6_quality": with_package(op6_quality),
    "op7_packing": with_package(op7_packing),
    "op8_token_counts": with_package(op8_token_counts),
    "op9_substring_dedup": with_package(op9_substring_dedup),
    "op10_near_dedup": with_package(op10_near_dedup),
    "op11_fingerprints": with_package(op11_fingerprints),
    "op12_vector_codes": with_package(op12_vector_codes),
    "op13_token_alignment": with_package(op13_token_alignment),
}

ORACLE_SQL: dict[str, str] = {"op2_exact_dedup": OP2_SQL, "op3_chat_format": OP3_SQL, "op11_fingerprints": OP11_SQL, "op12_vector_codes": OP12_SQL}
