"""The operators wired to the star-schema tables, with SQL twins for comparison."""
