"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .decontaminate import OP2_SQL, op2_decontamination
from .media import op6_media_columns
from .packing import op5_best_fit_packing
from .quality import op9_quality
from .simhash import op8_simhash
from .substring import OP3_SQL, op3_substring_dedup
from .token_store import op10_token_store
from .toxicity import op7_toxicity
from .urls import OP4_SQL, op4_url_filter
from .warc import OP1_SQL, op1_warc

QUERIES = {f.__name__: f for f in (op1_warc, op2_decontamination, op3_substring_dedup, op4_url_filter, op5_best_fit_packing, op6_media_columns, op7_toxicity, op8_simhash, op9_quality, op10_token_store)}
SQL = {"op1_warc": OP1_SQL, "op2_decontamination": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op4_url_filter": OP4_SQL}
