"""Operators for preparing language-model training data.

Every module here stands alone from the retrieval engine; ``queries.py`` holds the
registered queries and their SQL. Documents are a table with ``doc_id`` and ``text``;
other columns pass by untouched, whatever their names.
"""
