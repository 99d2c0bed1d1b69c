"""Tables that grow while they are read."""
