"""Training-data operators: extraction, language, deduplication, mixing, tokens and search.

Nothing outside this folder imports it; ``dexspark.llm.registry`` lists its queries.
"""
