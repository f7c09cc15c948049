"""The corpus operators' queries and, where SQL can express them, their oracles."""

from . import chat, graph, hmm, infill, jaccard, langid, licences, pack, quantise, shard, suffixes, toxic
from .decontaminate import op9_benchmark_decontamination

QUERIES = {f.__name__: f for f in (chat.op1_chat_formatting, langid.op2_language_id, pack.op3_packing, jaccard.op4_ngram_jaccard_join, shard.op5_sharding, hmm.op6_hidden_markov_lm, toxic.op7_toxicity, suffixes.op8_suffix_array_dedup, op9_benchmark_decontamination, graph.op10_embedding_near_dedup, licences.op11_license_scans, quantise.op12_vector_code_compression, infill.op13_fill_in_middle)}

ORACLE_SQL: dict[str, str] = {"op1_chat_formatting": chat.ORACLE_SQL, "op5_sharding": shard.ORACLE_SQL, "op11_license_scans": licences.ORACLE_SQL, "op12_vector_code_compression": quantise.ORACLE_SQL, "op13_fill_in_middle": infill.ORACLE_SQL}
