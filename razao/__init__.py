"""Bank-statement ledger on Spark: statements in, exact de-duplicated ledger out."""
