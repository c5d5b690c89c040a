"""sluice: sketching and sparse recovery of weighted key streams on Spark."""
