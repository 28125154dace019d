"""Knowledge-graph pattern analytics expressed as PySpark DataFrame plans."""
