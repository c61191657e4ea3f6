"""vecsieve: descriptor search and retrieval evaluation on Spark."""
