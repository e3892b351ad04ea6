"""Loan-repayment feature and forecast analytics as Spark DataFrame plans."""
