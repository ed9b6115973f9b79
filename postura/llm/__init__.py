"""Training-data operators: text quality, dedup, privacy and tokenisation on Spark."""
