"""The registered queries of these operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import embeddings, mixing, pieces, quality, rules, simhash, suffixes, toxicity, urls, warc

QUERIES = {
    "op1_embeddings": embeddings.op1_embeddings,
    "op2_simhash": simhash.op2_simhash,
    "op3_pieces": pieces.op3_pieces,
    "op4_quality": quality.op4_quality,
    "op5_rules": rules.op5_rules,
    "op6_warc": warc.op6_warc,
    "op7_mixing": mixing.op7_mixing,
    "op8_suffixes": suffixes.op8_suffixes,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_urls": urls.op10_urls,
}
SQL = {
    "op1_embeddings": embeddings.OP1_SQL,
    "op6_warc": warc.OP6_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op8_suffixes": suffixes.OP8_SQL,
    "op10_urls": urls.OP10_SQL,
}
