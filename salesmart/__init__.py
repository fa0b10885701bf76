"""Retail sales marts on Spark: staging, star schema, RFM segments and reports."""
