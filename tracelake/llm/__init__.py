"""Training-data operators: one module for each, and ``queries`` that registers them."""
