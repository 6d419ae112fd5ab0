"""terrane: gridded spatial planning analytics expressed as Spark DataFrame plans."""
