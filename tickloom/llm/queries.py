"""The queries of this package and the SQL that some can be held against."""

from __future__ import annotations

from .exact_dedup import OP4_SQL, op4_exact_dedup
from .langid import op1_langid
from .lm_score import op5_lm_score
from .mixing import OP7_SQL, op7_mixing
from .quality import op8_quality
from .repeats import OP6_SQL, op6_repeats
from .sampled_pieces import op9_sampled_pieces
from .simhash import op2_simhash
from .topk import OP10_SQL, op10_topk
from .warc import OP3_SQL, op3_warc

QUERIES = {
    "op1_langid": op1_langid,
    "op2_simhash": op2_simhash,
    "op3_warc": op3_warc,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_lm_score": op5_lm_score,
    "op6_repeats": op6_repeats,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_sampled_pieces": op9_sampled_pieces,
    "op10_topk": op10_topk,
}
SQL = {
    "op3_warc": OP3_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op6_repeats": OP6_SQL,
    "op7_mixing": OP7_SQL,
    "op10_topk": OP10_SQL,
}
