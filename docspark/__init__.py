"""docspark: document typing, field extraction and label feedback on Spark."""
