"""Network-flow analytics and anomaly detection as Spark DataFrame jobs."""

__version__ = "0.1.0"
