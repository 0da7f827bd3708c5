"""riskpanel: panel-data credit-risk analytics as Spark DataFrame jobs."""
