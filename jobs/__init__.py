"""Runnable jobs on the library: each module has ``run(spark, ...)`` and a command line."""
