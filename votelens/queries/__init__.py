"""The queries over the given tables and their SQL, by topic."""

from __future__ import annotations

from votelens.queries import evaluation, evidence, grading, preparation, seeding, signals, traces

TOPICS = (preparation, signals, evaluation, evidence, grading, traces, seeding)
QUERIES = {name: query for topic in TOPICS for name, query in topic.QUERIES.items()}
ORACLES = {name: sql for topic in TOPICS for name, sql in topic.ORACLES.items()}
