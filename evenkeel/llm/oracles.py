"""SQL over the same tables, for queries that SQL can express."""

from __future__ import annotations

from evenkeel.llm import maxscore, mixing, prefix_trie, role_repair, url_globs

ORACLES: dict[str, str] = {
    "op8_source_mixing": mixing.oracle(),
    "op9_maxscore_top_k": maxscore.ORACLE,
    "op11_url_globs": url_globs.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_role_repair": role_repair.ORACLE,
}
