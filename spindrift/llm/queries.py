"""The registered queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import cap_filters, fill_middle, jaccard_join, positional_index, warc
from .cap_filters import op7_cap_filters
from .fill_middle import op13_fill_middle
from .jaccard_join import op9_jaccard_groups
from .language_id import op2_string_kernel
from .media import op3_media_columns
from .packing import op4_bin_completion
from .pieces import op5_streaming_viterbi
from .positional_index import op11_positional_index
from .quality import op8_random_indexing
from .token_store import op1_token_store
from .url_rules import op6_association_rules
from .warc import op10_warc_transactions
from .whitening import op12_exact_whitening

QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_string_kernel": op2_string_kernel,
    "op3_media_columns": op3_media_columns,
    "op4_bin_completion": op4_bin_completion,
    "op5_streaming_viterbi": op5_streaming_viterbi,
    "op6_association_rules": op6_association_rules,
    "op7_cap_filters": op7_cap_filters,
    "op8_random_indexing": op8_random_indexing,
    "op9_jaccard_groups": op9_jaccard_groups,
    "op10_warc_transactions": op10_warc_transactions,
    "op11_positional_index": op11_positional_index,
    "op12_exact_whitening": op12_exact_whitening,
    "op13_fill_middle": op13_fill_middle,
}

ORACLES: dict[str, str] = {
    "op7_cap_filters": cap_filters.ORACLE,
    "op9_jaccard_groups": jaccard_join.ORACLE,
    "op10_warc_transactions": warc.ORACLE,
    "op11_positional_index": positional_index.ORACLE,
    "op13_fill_middle": fill_middle.ORACLE,
}
