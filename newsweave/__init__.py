"""News-surveillance analytics expressed as Spark DataFrame plans."""
