"""The queries ``opN_<name>`` and their DuckDB equivalents."""

from . import decontam, jaccard, kneser_ney, licenses, mixing, pii, quality, secrets, tokens, urlfilter

_MODULES = [mixing, licenses, pii, quality, kneser_ney, urlfilter, jaccard, secrets, tokens, decontam]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
