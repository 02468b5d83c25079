"""Jobs bound to tables, as queries."""
