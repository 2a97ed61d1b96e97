"""All queries of the library and their SQL."""

from tessera.plans import chains, more, relational, vector

QUERIES = {**vector.QUERIES, **relational.QUERIES, **more.QUERIES, **chains.QUERIES}
ORACLES = {**vector.ORACLES, **relational.ORACLES, **more.ORACLES, **chains.ORACLES}
