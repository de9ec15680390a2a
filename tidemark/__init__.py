"""A versioned-log engine on Spark: tables are append-only logs of (key, seq, op, value), reads are queries over them."""
