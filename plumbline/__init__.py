"""Data product certification on Spark: build, profile, measure, check, secure, explain and score tables as DataFrame plans."""
