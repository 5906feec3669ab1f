"""Table builders: thin compositions of the operators."""
