"""Queries by name, each with the SQL that tells its result (None where SQL cannot)."""

from reqloom.plans import accounts, exchanges, extracts, files, matrix, relations, texts, timed

QUERIES = {**matrix.QUERIES, **texts.QUERIES, **relations.QUERIES, **extracts.QUERIES, **exchanges.QUERIES, **accounts.QUERIES, **files.QUERIES, **timed.QUERIES}
