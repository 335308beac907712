"""Domain analyses composed from the operators."""
