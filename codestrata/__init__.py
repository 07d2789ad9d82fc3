"""codestrata: code, history and text analytics expressed as Spark plans."""

__all__ = ["tables", "operators", "sources", "functions", "plans", "streaming"]
