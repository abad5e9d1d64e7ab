"""The queries of this subpackage, by the names that the driver knows."""

from __future__ import annotations

from .dedup import op1_dedup
from .html import op4_html
from .jaccard import OP10_SQL, op10_jaccard
from .langid import op8_langid
from .lm import OP7_SQL, op7_lm
from .mpeg import op3_media
from .pack import op5_packing
from .shard import op6_sharding
from .tokenize import op2_bpe
from .topk import OP9_SQL, op9_topk

QUERIES = {"op1_dedup": op1_dedup, "op2_bpe": op2_bpe, "op3_media": op3_media, "op4_html": op4_html, "op5_packing": op5_packing, "op6_sharding": op6_sharding, "op7_lm": op7_lm, "op8_langid": op8_langid, "op9_topk": op9_topk, "op10_jaccard": op10_jaccard}
ORACLE_SQL = {"op7_lm": OP7_SQL, "op9_topk": OP9_SQL, "op10_jaccard": OP10_SQL}
