"""The queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, mixing, neardup, packing, pii, quality, sharding, topk, toxicity, warc

QUERIES = {
    "op1_line_frequency": quality.op1_line_frequency,
    "op2_bounded_packing": packing.op2_bounded_packing,
    "op3_warc_transactions": warc.op3_warc_transactions,
    "op4_pivotal_mixing": mixing.op4_pivotal_mixing,
    "op5_bilstm_crf": pii.op5_bilstm_crf,
    "op6_schema_chat": chat.op6_schema_chat,
    "op7_histogram_topk": topk.op7_histogram_topk,
    "op8_nb_ngram_toxicity": toxicity.op8_nb_ngram_toxicity,
    "op9_bayes_minhash": neardup.op9_bayes_minhash,
    "op10_rendezvous_shards": sharding.op10_rendezvous_shards,
}

ORACLE_SQL = {
    "op1_line_frequency": quality.SQL_OP1,
    "op3_warc_transactions": warc.SQL_OP3,
    "op6_schema_chat": chat.SQL_OP6,
    "op7_histogram_topk": topk.SQL_OP7,
    "op9_bayes_minhash": neardup.SQL_OP9,
    "op10_rendezvous_shards": sharding.SQL_OP10,
}
