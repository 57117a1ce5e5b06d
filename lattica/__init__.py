"""lattica: Spark-first analytics over collections of linked, tagged text notes."""
