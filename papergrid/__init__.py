"""Document table and layout analytics on Spark: page geometry in, structured tables and ordered text out."""
