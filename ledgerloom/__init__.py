"""Fraud analytics over payment transactions, written as Spark DataFrame jobs."""
