"""Training-data operators. May import the core; nothing in the core imports this package."""
