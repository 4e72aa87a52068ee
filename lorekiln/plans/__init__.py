"""Tables that queries start from."""
