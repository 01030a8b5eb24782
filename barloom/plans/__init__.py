"""Registered queries over the warehouse tables, and the SQL that checks them."""
