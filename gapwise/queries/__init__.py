"""One query per operator over the given tables, with the SQL that checks it."""
