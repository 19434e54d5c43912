"""Event-driven market analytics and corpus preparation on PySpark."""
