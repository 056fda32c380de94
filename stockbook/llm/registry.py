"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from .fill_in_middle import OP12_SQL, op12_fill_in_middle
from .line_dedup import op8_line_dedup
from .mixing import op3_entropy_mixing
from .norm_search import OP11_SQL, op11_norm_bucket_search
from .packing import op5_best_fit_packing
from .quality import op7_quality_classifier
from .search import op9_topk_search
from .shingle_join import op10_ngram_jaccard_join
from .spotsigs import op1_spotsigs_fingerprints
from .token_counts import op4_token_counts
from .token_output import op2_token_matrices
from .url_filters import OP13_SQL, op13_url_filters
from .warc import op6_warc

QUERIES = {
    "op1_spotsigs_fingerprints": op1_spotsigs_fingerprints,
    "op2_token_matrices": op2_token_matrices,
    "op3_entropy_mixing": op3_entropy_mixing,
    "op4_token_counts": op4_token_counts,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_warc": op6_warc,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_line_dedup": op8_line_dedup,
    "op9_topk_search": op9_topk_search,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_norm_bucket_search": op11_norm_bucket_search,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_url_filters": op13_url_filters,
}

ORACLE: dict[str, str] = {
    "op11_norm_bucket_search": OP11_SQL,
    "op12_fill_in_middle": OP12_SQL,
    "op13_url_filters": OP13_SQL,
}
