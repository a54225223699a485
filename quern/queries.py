"""All queries of the library, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

from quern.plans import corpus, evaluation, features, files, learning, replies, rules, search, text

QUERIES: dict = {}
ORACLES: dict = {}
for _plan in (corpus, text, search, features, evaluation, learning, rules, replies, files):
    QUERIES |= _plan.QUERIES
    ORACLES |= _plan.ORACLES
