"""Queries of this subpackage, and their SQL where SQL can express them."""

from . import contamination, conversations, cuckoo, merkle, neardup, quality
from .bpe import op1_byte_bpe
from .contamination import op4_decontamination
from .conversations import op11_conversations
from .cuckoo import op12_exact_duplicates
from .htmlmain import op5_main_text
from .langid import op6_language_id
from .licenses import op10_licenses
from .merkle import op13_merkle
from .neardup import op3_near_duplicates
from .pii import op8_pii
from .quality import op2_quality
from .token_files import op9_token_files
from .toxicity import op7_toxicity

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_quality": op2_quality,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_decontamination": op4_decontamination,
    "op5_main_text": op5_main_text,
    "op6_language_id": op6_language_id,
    "op7_toxicity": op7_toxicity,
    "op8_pii": op8_pii,
    "op9_token_files": op9_token_files,
    "op10_licenses": op10_licenses,
    "op11_conversations": op11_conversations,
    "op12_exact_duplicates": op12_exact_duplicates,
    "op13_merkle": op13_merkle,
}

ORACLE = {
    "op2_quality": quality.SQL,
    "op3_near_duplicates": neardup.SQL,
    "op4_decontamination": contamination.SQL,
    "op11_conversations": conversations.SQL,
    "op12_exact_duplicates": cuckoo.SQL,
    "op13_merkle": merkle.SQL,
}
