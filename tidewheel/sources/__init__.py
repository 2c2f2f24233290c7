"""Tables of arguments."""
