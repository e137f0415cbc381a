"""Operators put together: the registered queries and the SQL that states them."""
