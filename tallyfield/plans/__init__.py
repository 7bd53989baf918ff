"""Importing this package registers all queries."""

from tallyfield.plans import advice, builds, corpus, documents, draft, drafts, evaluation, features, history, live, models, panel, refresh, review, scoring, timeline  # noqa: F401
