"""Fleet-wide evidence lake for agent session logs, as Spark DataFrame transforms."""

__version__ = "0.1.0"
