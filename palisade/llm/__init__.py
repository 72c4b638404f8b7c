"""Training-data operators: archives, quality, near-duplicates, tokens, packing, language-model scores and chat windows.

Nothing outside this package imports it. ``queries()`` and ``oracles()`` list what it registers.
"""

from palisade.llm.registry import oracles, queries

__all__ = ["oracles", "queries"]
