"""Column functions. Lengths are bytes, as everywhere in this library."""
