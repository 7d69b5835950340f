"""Column expressions: text clean-up, classifiers and rounding."""
