"""Tables of bars and what is aligned with them."""
