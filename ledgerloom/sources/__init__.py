"""Readers: rescued CSV and JSON, binary documents, parameterised SQL, tables."""
