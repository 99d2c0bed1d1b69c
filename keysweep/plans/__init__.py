"""How operators are put together: stored intermediate tables, skewed joins, whole scans."""
