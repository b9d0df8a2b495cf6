"""Named queries over the driver's tables, with their SQL."""

from . import duplicates, gates, ingest, moderation, policy, records, stats, streams, text

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (duplicates, stats, text, policy, moderation, ingest, gates, records, streams):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
