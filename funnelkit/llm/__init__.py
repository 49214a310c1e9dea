"""Training-data operators: PII, chat, URLs, dedup, token files, toxicity, mixing, decontamination, language.

Nothing outside this subpackage imports it. Every operator takes a DataFrame,
selects only the columns it names and leaves the caller's session settings
alone. Tables that cut lineage go to `spark.checkpoint.dir`.
"""
