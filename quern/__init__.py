"""quern: a Spark-first engine for time-stamped text, entities and outcomes."""

__version__ = "0.1.0"
