"""Named queries: ``(spark, sf_dir) -> DataFrame``, and the SQL that must give the same rows."""
