"""All queries of this subpackage."""

from tagmill.llm import q_chat, q_decontaminate, q_language, q_mixing, q_quality, q_sharding, q_signature_tree, q_suffix_groups, q_token_files, q_topk

_MODULES = (q_chat, q_suffix_groups, q_quality, q_sharding, q_decontaminate, q_language, q_topk, q_mixing, q_token_files, q_signature_tree)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
