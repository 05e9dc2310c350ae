"""Training-data operators: licence scans, de-duplication, tokenisation, media columns, archives, personal data, quality.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries only when it is present.
"""
