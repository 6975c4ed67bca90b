"""Text corpora to document tables, and bias-controlled train/test splits, on Spark."""
