"""Trip analytics on Spark: pure DataFrame and Column functions."""
