"""Pipelines that chain the operators, and their bindings to the test tables."""
