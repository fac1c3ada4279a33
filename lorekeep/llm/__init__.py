"""Training-data operators: near-duplicates, quality, tokens, chat, leaks and personal data.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin
``opN_<name>`` queries; every other module is one operator with its own
general interface.
"""
