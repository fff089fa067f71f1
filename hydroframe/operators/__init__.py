"""DataFrame-to-DataFrame operators, one module per level of the data model."""
