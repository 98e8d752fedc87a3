"""All queries of the library and their SQL counterparts."""

from . import audits, catalog, models, records, review, scans, series

MODULES = (series, models, records, review, catalog, scans, audits)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: sql for m in MODULES for k, sql in m.ORACLES.items()}
