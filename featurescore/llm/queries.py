"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontaminate import op6_decontaminate
from .jaccard_join import op7_jaccard_join
from .language_id import op10_language_id
from .lexical_search import OP11_SQL, op11_lexical_search
from .license_scan import op9_license_scan
from .merkle import OP12_SQL, op12_merkle_manifest
from .mixing import OP3_SQL, op3_mixing
from .quality_rules import op8_quality_rules
from .secret_scan import op5_secret_scan
from .suffix_dedup import op1_suffix_dedup
from .token_counts import op13_token_counts
from .toxicity import op4_toxicity
from .warc import OP2_SQL, op2_warc

QUERIES = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_warc, op3_mixing, op4_toxicity, op5_secret_scan, op6_decontaminate, op7_jaccard_join, op8_quality_rules, op9_license_scan, op10_language_id, op11_lexical_search, op12_merkle_manifest, op13_token_counts)
}
ORACLE_SQL = {"op2_warc": OP2_SQL, "op3_mixing": OP3_SQL, "op11_lexical_search": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
