"""Training-data operators: each is a DataFrame job; nothing else in the library imports them."""
