"""Column functions: text, payloads, language. Every function maps columns to columns."""
