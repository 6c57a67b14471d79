"""Queries over the given tables, one for each operator, each with the same answer in DuckDB SQL where SQL has one."""
