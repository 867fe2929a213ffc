"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .bagminhash import op9_bagminhash
from .exact_dedup import OP2_SQL, op2_exact_dedup
from .golay_simhash import op13_golay_simhash
from .language_id import op4_language_id
from .line_chunks import OP8_SQL, op8_line_chunks
from .merkle import OP12_SQL, op12_merkle_manifest
from .mixing import OP5_SQL, op5_mixing
from .packing import op10_packing
from .quality import op1_quality
from .quotes import OP7_SQL, op7_quotes
from .secrets import op6_secrets
from .threshold_topk import OP3_SQL, op3_threshold_topk
from .token_alignment import op11_token_alignment

QUERIES = {
    f.__name__: f for f in (
        op1_quality,
        op2_exact_dedup,
        op3_threshold_topk,
        op4_language_id,
        op5_mixing,
        op6_secrets,
        op7_quotes,
        op8_line_chunks,
        op9_bagminhash,
        op10_packing,
        op11_token_alignment,
        op12_merkle_manifest,
        op13_golay_simhash,
    )
}
ORACLE_SQL = {"op2_exact_dedup": OP2_SQL, "op3_threshold_topk": OP3_SQL, "op5_mixing": OP5_SQL, "op7_quotes": OP7_SQL, "op8_line_chunks": OP8_SQL, "op12_merkle_manifest": OP12_SQL}
