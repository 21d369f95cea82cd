"""Image analytics on Spark: images are DataFrame rows, operators are expressions, joins and aggregations."""
