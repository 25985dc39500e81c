"""Document analytics for contract text, expressed as Spark plans."""
