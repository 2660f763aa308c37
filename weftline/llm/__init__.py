"""Training-data operators: mixing, quality, dedup, language, language models, tokens, secrets, licences.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
