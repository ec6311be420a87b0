"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame,
optionally paired with an equivalent DuckDB SQL text used as an oracle."""
