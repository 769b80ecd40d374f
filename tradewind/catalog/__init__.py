"""Every job as a query over the driver tables, with the equivalent DuckDB SQL."""
