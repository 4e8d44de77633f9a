"""Training-data operators: dedup, filtering, extraction, mixing and tokenising as Spark jobs.

Nothing outside this folder imports it. Ship the folder to executors with
``--py-files`` (or install it on every machine): tasks import its helpers.
"""
