"""Functions of the sparse linear algebra engine."""
