"""All registered queries with their SQL, by operator id."""

from . import conversations, documents, events, features, insights, models, quality, statistics

QUERIES: dict = {}
ORACLE: dict = {}
for _part in (quality, events, features, statistics, insights, documents, conversations, models):
    QUERIES |= _part.QUERIES
    ORACLE |= _part.ORACLE
