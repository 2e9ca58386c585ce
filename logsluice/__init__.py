"""Log analytics on Spark: screening, parsing, normalising, querying, detection, mining and export of machine logs."""
