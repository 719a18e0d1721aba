"""The registered queries: each reads the given tables and names the SQL it is checked against."""
