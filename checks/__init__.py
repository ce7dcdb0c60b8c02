"""Registered queries over the provided tables and the SQL each must agree with."""
