"""Graph algorithms as DataFrame operators."""
