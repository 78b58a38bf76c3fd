"""The modules of this subpackage with QUERIES and SQL."""

from __future__ import annotations

from types import ModuleType


def modules() -> list[ModuleType]:
    from codequarry.llm import defects, docpairs, handwritten, leakage, personal, quantiles, reading, tokens

    return [personal, quantiles, handwritten, docpairs, defects, tokens, leakage, reading]
