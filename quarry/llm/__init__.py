"""Training-data operators for document, page, conversation and vector tables.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin
``opN_*`` queries and their SQL; every other module is one operator.
"""
