"""Registered checks: derived inputs, Spark queries and the SQL that must agree with them."""
