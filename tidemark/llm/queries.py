"""The registered queries of this subpackage and their SQL counterparts."""

from . import chains, decontaminate, extract, infill, lines, mixing, nearcopy, packing, quality, resample, suffixes, tokens, warc

MODULES = (chains, tokens, warc, suffixes, lines, decontaminate, extract, nearcopy, mixing, quality, packing, resample, infill)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in MODULES for k, q in m.ORACLES.items()}
