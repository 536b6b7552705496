"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from chronoloom.llm.alignment import op11_alignment
from chronoloom.llm.chat import op9_chat
from chronoloom.llm.decontaminate import OP10_SQL, op10_decontamination
from chronoloom.llm.fingerprint import op6_fingerprint
from chronoloom.llm.langid import op3_language
from chronoloom.llm.mixing import OP7_SQL, op7_mixing
from chronoloom.llm.neardup import op5_near_duplicates
from chronoloom.llm.pieces import op13_pieces
from chronoloom.llm.sharding import op8_sharding
from chronoloom.llm.structure import op12_structure
from chronoloom.llm.surrogates import op4_surrogates
from chronoloom.llm.tokens import op1_tokens
from chronoloom.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_tokens": op1_tokens,
    "op2_toxicity": op2_toxicity,
    "op3_language": op3_language,
    "op4_surrogates": op4_surrogates,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_fingerprint": op6_fingerprint,
    "op7_mixing": op7_mixing,
    "op8_sharding": op8_sharding,
    "op9_chat": op9_chat,
    "op10_decontamination": op10_decontamination,
    "op11_alignment": op11_alignment,
    "op12_structure": op12_structure,
    "op13_pieces": op13_pieces,
}

ORACLES = {"op7_mixing": OP7_SQL, "op10_decontamination": OP10_SQL}
