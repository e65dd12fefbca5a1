"""Decision tracking on Spark: ledgers, evidence, requirements and questions as DataFrame operators."""

__version__ = "0.1.0"
