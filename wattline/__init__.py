"""Load-curve analytics as Spark DataFrame operators: see README.md."""
