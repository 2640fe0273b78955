"""End-to-end plans over the test tables: the registered queries and the
DuckDB SQL that checks them."""
