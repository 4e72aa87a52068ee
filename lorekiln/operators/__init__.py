"""DataFrame operators, one module a concern."""
