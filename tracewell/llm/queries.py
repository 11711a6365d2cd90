"""Queries of this subpackage over the given tables, and SQL where it can express them."""

from __future__ import annotations

from tracewell.llm.counts import op5_token_counts
from tracewell.llm.decontaminate import OP3_SQL, op3_decontaminate
from tracewell.llm.filter_audit import OP11_SQL, op11_filter_audit
from tracewell.llm.fingerprints import op2_fingerprints
from tracewell.llm.idstore import op1_id_store
from tracewell.llm.negatives import OP13_SQL, op13_negatives
from tracewell.llm.packing import op6_packing
from tracewell.llm.quality import op8_quality
from tracewell.llm.repacking import op12_repacking
from tracewell.llm.secrets import op7_secrets
from tracewell.llm.sharding import op9_sharding
from tracewell.llm.simhash import op10_simhash
from tracewell.llm.warc import OP4_SQL, op4_warc

QUERIES = {f.__name__: f for f in (op1_id_store, op2_fingerprints, op3_decontaminate, op4_warc, op5_token_counts, op6_packing, op7_secrets, op8_quality, op9_sharding, op10_simhash, op11_filter_audit, op12_repacking, op13_negatives)}
SQL = {"op3_decontaminate": OP3_SQL, "op4_warc": OP4_SQL, "op11_filter_audit": OP11_SQL, "op13_negatives": OP13_SQL}
