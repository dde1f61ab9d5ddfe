"""Physical-shape helpers (skew splitting, size guards) and the product strategies."""
