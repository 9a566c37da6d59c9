"""The queries of this package, by name, and the SQL that some of them are held against."""

from __future__ import annotations

from . import exact_dedup, secret_scan, url_filter
from .chat_format import op4_chat_format
from .conversation_repair import op11_conversation_repair
from .exact_dedup import op2_exact_dedup
from .jaccard_join import op3_jaccard_join
from .license_scan import op6_license_scan
from .mixing import op10_mixing
from .packing import op8_packing
from .prefix_trie import op13_prefix_trie
from .quality_classifier import op1_quality_classifier
from .quality_rules import op9_quality_rules
from .secret_scan import op12_secret_scan
from .token_records import op5_token_records
from .url_filter import op7_url_filter

_ALL = (
    op1_quality_classifier, op2_exact_dedup, op3_jaccard_join, op4_chat_format, op5_token_records,
    op6_license_scan, op7_url_filter, op8_packing, op9_quality_rules, op10_mixing,
    op11_conversation_repair, op12_secret_scan, op13_prefix_trie,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE: dict[str, str] = {"op2_exact_dedup": exact_dedup.ORACLE, "op7_url_filter": url_filter.oracle(), "op12_secret_scan": secret_scan.oracle()}
