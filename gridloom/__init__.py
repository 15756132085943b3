"""gridloom: a Spark-first analytics engine for stacks of gridded measurements."""
