"""ordlake: document-to-order analytics expressed as Spark DataFrame jobs."""
