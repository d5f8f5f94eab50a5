"""End-to-end dataflows built from the operators."""
