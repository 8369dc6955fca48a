"""Whole queries over tables, and the DuckDB SQL that checks them."""
