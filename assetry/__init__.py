"""Asset catalog on Spark: list files, parse names, validate assets, publish."""
