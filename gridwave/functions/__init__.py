"""Column-level helpers: complex arithmetic, index encodings, seeded draws."""
