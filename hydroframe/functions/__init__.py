"""Column functions and DataFrame aggregates shared by the operators."""
