"""All registered queries of the library, and their SQL."""

from . import files, queries

QUERIES = queries.QUERIES | files.QUERIES
ORACLES = queries.ORACLES | files.ORACLES
flagship = queries.flagship
