"""Queries of this subpackage and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from . import chat, exactdedup, licences, merkle, urlfilter
from .alignment import op13_alignment
from .chat import op7_chat_format
from .exactdedup import op3_exact_dedup
from .licences import op2_licence_scan
from .merkle import op12_merkle_manifest
from .packing import op10_best_fit_packing
from .pieces import op9_sentencepiece
from .quality_model import op6_quality_classifier
from .quality_rules import op8_quality_rules
from .simhash import op1_simhash
from .toxicity import op11_toxicity
from .urlfilter import op4_url_filter
from .wavelet import op5_token_ids

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_licence_scan": op2_licence_scan,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_token_ids": op5_token_ids,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_chat_format": op7_chat_format,
    "op8_quality_rules": op8_quality_rules,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_toxicity": op11_toxicity,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_alignment": op13_alignment,
}

SQL: dict[str, str] = {
    "op2_licence_scan": licences.SQL,
    "op3_exact_dedup": exactdedup.SQL,
    "op4_url_filter": urlfilter.SQL,
    "op7_chat_format": chat.SQL,
    "op12_merkle_manifest": merkle.SQL,
}
