"""The operators' queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from vectide.llm import chat, embdedup, pii, urlrank
from vectide.llm.bpe import op7_bpe
from vectide.llm.chat import op2_chat
from vectide.llm.decontam import op1_decontam
from vectide.llm.embdedup import op5_embdedup
from vectide.llm.langid import op4_langid
from vectide.llm.lmscore import op10_lmscore
from vectide.llm.pii import op6_pii
from vectide.llm.simhash import op9_simhash
from vectide.llm.toxicity import op3_toxicity
from vectide.llm.urlrank import op8_urlrank

QUERIES = {f.__name__: f for f in (op1_decontam, op2_chat, op3_toxicity, op4_langid, op5_embdedup, op6_pii, op7_bpe, op8_urlrank, op9_simhash, op10_lmscore)}

ORACLES = {"op2_chat": chat.OP2_SQL, "op5_embdedup": embdedup.OP5_SQL, "op6_pii": pii.oracle(), "op8_urlrank": urlrank.oracle()}
