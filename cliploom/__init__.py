"""cliploom: clip-event analytics expressed as Spark DataFrame plans."""
