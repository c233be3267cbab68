"""Registered queries: operators applied to the bundled tables, each with the SQL that checks it."""
