"""End-to-end compositions of the operators and their bindings to the driver tables."""
