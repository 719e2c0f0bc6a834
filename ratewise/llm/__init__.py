"""Training-data operators: token counts, sharding, de-duplication, scans,
quality rules, decontamination and tokenizer sampling.

Nothing outside this subpackage imports it (``__spark_entry__.py`` adds its
queries when it is present).
"""
