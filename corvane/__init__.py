"""corvane: cataloguing, linking and de-duplicating of large file and document collections on Spark."""
