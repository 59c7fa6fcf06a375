"""The queries of this subpackage and the SQL that some can be compared with."""

from . import embeddings, huffman, katz, langid, mixing, neardup, packing, phrases, pii, suffixes, topk, trie, warc

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_dart_minhash": neardup.op2_dart_minhash,
    "op3_embedding_near_dedup": embeddings.op3_embedding_near_dedup,
    "op4_warc": warc.op4_warc,
    "op5_huffman_ids": huffman.op5_huffman_ids,
    "op6_mixing": mixing.op6_mixing,
    "op7_katz_backoff": katz.op7_katz_backoff,
    "op8_pii": pii.op8_pii,
    "op9_exact_top_k": topk.op9_exact_top_k,
    "op10_pack_binary": packing.op10_pack_binary,
    "op11_suffix_array_dedup": suffixes.op11_suffix_array_dedup,
    "op12_phrase_collocations": phrases.op12_phrase_collocations,
    "op13_conversation_trie": trie.op13_conversation_trie,
}
ORACLE_SQL: dict[str, str] = {"op6_mixing": mixing.oracle_sql(), "op9_exact_top_k": topk.ORACLE_SQL, "op12_phrase_collocations": phrases.oracle_sql()}
