"""The queries of this package, by name, and their SQL where SQL can express them."""

from sedimenta.llm import bpe, embeddings, licenses, linededup, packing, repetition, sharding, simhash, token_files, toxicity

_MODULES = (toxicity, bpe, token_files, repetition, packing, licenses, sharding, simhash, linededup, embeddings)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
