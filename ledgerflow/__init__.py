"""Spark jobs for bank-statement forensics."""
