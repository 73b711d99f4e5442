"""searchloom: building, searching and measuring text-retrieval collections on Spark."""
