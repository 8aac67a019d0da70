"""regionflow: region tracking and redaction over frame sequences as PySpark dataflows."""

__version__ = "0.1.0"
