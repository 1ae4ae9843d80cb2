"""The queries of this folder, by name, and the SQL of those that SQL can express."""

from . import oracles
from . import queries as q

QUERIES = {
    "op1_quality": q.op1_quality,
    "op2_packing": q.op2_packing,
    "op3_pii": q.op3_pii,
    "op4_warc": q.op4_warc,
    "op5_chat": q.op5_chat,
    "op6_toxicity": q.op6_toxicity,
    "op7_simhash": q.op7_simhash,
    "op8_decontaminate": q.op8_decontaminate,
    "op9_token_files": q.op9_token_files,
    "op10_html_text": q.op10_html_text,
    "op11_align": q.op11_align,
    "op12_line_dedup": q.op12_line_dedup,
    "op13_search": q.op13_search,
}
ORACLES: dict[str, str] = {
    "op1_quality": oracles.OP1_QUALITY,
    "op4_warc": oracles.OP4_WARC,
    "op5_chat": oracles.OP5_CHAT,
    "op12_line_dedup": oracles.OP12_LINE_DEDUP,
    "op13_search": oracles.OP13_SEARCH,
}
