"""The registered queries outside the training-data subpackage, and their SQL."""

from .plans import analytics, audits, bundle, canonical, checks, graph, hypotheses, kpis, more, movement, plugs, retrieval, reviews, text

_ALL = (canonical.query, analytics.query, text.query, more.query, movement.query, hypotheses.query, bundle.query, retrieval.query, kpis.query, reviews.query, plugs.query, graph.query, checks.query, audits.query)
QUERIES: dict = {name: f for r in _ALL for name, f in r.queries.items()}
ORACLE_SQL: dict = {name: sql for r in _ALL for name, sql in r.sql.items()}
