"""The queries of this subpackage, by the names under which they are registered."""

from __future__ import annotations

from . import ann, decontam, linededup, mixing, quality, sharding, simhash, tokens, urlrules, warc

QUERIES = {
    "op1_token_binary": tokens.op1,
    "op2_pareto_mixing": mixing.op2,
    "op3_projected_neighbours": ann.op3,
    "op4_warc_archive": warc.op4,
    "op5_extendible_sharding": sharding.op5,
    "op6_url_rules": urlrules.op6,
    "op7_line_dedup": linededup.op7,
    "op8_simhash_near_dedup": simhash.op8,
    "op9_quality_qda": quality.op9,
    "op10_cgk_decontamination": decontam.op10,
}

#: Equivalent SQL, where SQL can express the operator.
ORACLE_SQL: dict[str, str] = {
    "op2_pareto_mixing": mixing.OP2_SQL,
    "op4_warc_archive": warc.OP4_SQL,
    "op5_extendible_sharding": sharding.OP5_SQL,
    "op6_url_rules": urlrules.OP6_SQL,
    "op7_line_dedup": linededup.OP7_SQL,
}
