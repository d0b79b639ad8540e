"""notewright: concept extraction, entity linking and corpus preparation on Spark."""

__version__ = "0.1.0"
