"""The queries of this folder and their SQL."""

from quern.llm import decontam, embeddings, langid, lines, mixing, repeats, simhash, suffix_tree, toxicity

QUERIES = {
    "op4_repeated_strings": repeats.op4_repeated_strings,
    "op1_suffix_tree": suffix_tree.op1_suffix_tree,
    "op9_simhash_dedup": simhash.op9_simhash_dedup,
    "op10_embedding_dedup": embeddings.op10_embedding_dedup,
    "op2_decontamination": decontam.op2_decontamination,
    "op3_substring_dedup": lines.op3_substring_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_mixing": mixing.op6_mixing,
    "op7_language_id": langid.op7_language_id,
    "op8_line_dedup": lines.op8_line_dedup,
}
ORACLE_SQL = {
    "op2_decontamination": decontam.OP2_SQL,
    "op3_substring_dedup": lines.OP3_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op8_line_dedup": lines.OP8_SQL,
}
