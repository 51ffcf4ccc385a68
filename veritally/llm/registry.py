"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .chat import op13_chat
from .contamination import op10_decontamination
from .ctw import op6_lm
from .language import op5_language
from .lines import op9_lines
from .minhash import op1_minhash
from .oracles import ORACLE_SQL
from .packing import op4_packing
from .pii import op2_pii
from .repair import op12_repair
from .runs import op11_runs
from .substrings import op7_substring
from .toxicity import op3_toxicity
from .vectors import op8_embeddings

QUERIES = (op1_minhash, op2_pii, op3_toxicity, op4_packing, op5_language, op6_lm, op7_substring, op8_embeddings, op9_lines, op10_decontamination, op11_runs, op12_repair, op13_chat)


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
