"""Operators for language-model training data. Nothing else in quern imports this subpackage."""

QUERY_MODULES: list[str] = ["quern.llm.neardup_queries", "quern.llm.contamination_queries", "quern.llm.mixing_queries", "quern.llm.names_queries", "quern.llm.langid_queries", "quern.llm.pii_queries"]
