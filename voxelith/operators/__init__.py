"""Operators: DataFrame to DataFrame, no hidden state."""
