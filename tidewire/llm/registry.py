"""The corpus operators' queries, by name."""

from __future__ import annotations

from tidewire.llm import (
    q_collocations,
    q_html,
    q_jaccard,
    q_langid,
    q_licences,
    q_media,
    q_neighbours,
    q_packing,
    q_quality,
    q_sentencepieces,
    q_sharding,
    q_substrings,
    q_whitening,
)

_MODULES = [q_jaccard, q_substrings, q_sentencepieces, q_neighbours, q_html, q_media, q_packing, q_langid, q_sharding, q_licences, q_collocations, q_whitening, q_quality]

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
