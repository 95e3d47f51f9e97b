"""One registered query per operator, and SQL where SQL can express it."""

from __future__ import annotations

from tracelink.llm.bpe import op7_bpe
from tracelink.llm.language_model import op11_interpolation
from tracelink.llm.lexical import OP13_SQL, op13_lexical
from tracelink.llm.mixing import OP10_SQL, op10_mixing
from tracelink.llm.mpeg import op8_mpeg
from tracelink.llm.negatives import OP12_SQL, op12_negatives
from tracelink.llm.simhash import op6_simhash
from tracelink.llm.token_counts import op2_token_counts
from tracelink.llm.token_ids import op1_token_ids
from tracelink.llm.topk import OP5_SQL, op5_mtree
from tracelink.llm.toxicity import op4_toxicity
from tracelink.llm.warc import OP3_SQL, op3_warc
from tracelink.llm.wrappers import op9_wrappers

QUERIES = {f.__name__: f for f in (op1_token_ids, op2_token_counts, op3_warc, op4_toxicity, op5_mtree, op6_simhash, op7_bpe, op8_mpeg, op9_wrappers, op10_mixing, op11_interpolation, op12_negatives, op13_lexical)}

SQL: dict[str, str] = {"op3_warc": OP3_SQL, "op5_mtree": OP5_SQL, "op10_mixing": OP10_SQL, "op12_negatives": OP12_SQL, "op13_lexical": OP13_SQL}
