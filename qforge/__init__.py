"""Question-bank analytics and corpus preparation on PySpark."""
