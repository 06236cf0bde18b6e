"""Operations on training corpora: token counts, duplicates, decontamination, language, shards.

Each module is one operator with its own interface; ``queries`` holds the registered queries
and ``oracles`` their DuckDB SQL. Nothing else in the library imports this package.
"""
