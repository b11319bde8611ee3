"""Training-data operators: quality, privacy, dedup, tokens, packing, language, HTML and secrets.

Nothing outside this subpackage imports it (``__spark_entry__.py`` adds its queries only if it is there).
Every operator takes DataFrames, looks at whole texts and lets Spark partition the work; Python runs only
inside Arrow batches, and anything broadcast has a stated size bound.
"""
