"""Spark-first analytics: label scoring, paired comparison, run-log and ledger
reconciliation operators as DataFrame pipelines."""
