"""millrace: corpus preparation and audit operators expressed as Spark DataFrame plans."""
