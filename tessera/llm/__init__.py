"""Training-data operators: language ID, deduplication, decontamination, token
counts, URL filters, mixing and WARC archives.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when the subpackage is present.
"""
