"""Training-data operators. Each module holds one operator; ``queries`` registers them."""
