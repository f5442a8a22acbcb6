"""Queries over the domain views; importing this registers them."""
