"""Cryptographic posture analytics on Spark DataFrames."""
