"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .decontaminate import op6_decontaminate
from .langid import op8_language
from .media import op9_media
from .minhash import op1_minhash
from .quality import op7_quality
from .secrets import op2_secrets
from .sentencepiece_op import op10_sentencepiece
from .sql import OP1_SQL, OP3_SQL
from .toxicity import op5_toxicity
from .urls import OP4_SQL, op4_url_filter
from .warc import op3_warc


def queries() -> dict:
    return {
        "op1_minhash": op1_minhash,
        "op2_secrets": op2_secrets,
        "op3_warc": op3_warc,
        "op4_url_filter": op4_url_filter,
        "op5_toxicity": op5_toxicity,
        "op6_decontaminate": op6_decontaminate,
        "op7_quality": op7_quality,
        "op8_language": op8_language,
        "op9_media": op9_media,
        "op10_sentencepiece": op10_sentencepiece,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash": OP1_SQL,
        "op3_warc": OP3_SQL,
        "op4_url_filter": OP4_SQL,
    }
