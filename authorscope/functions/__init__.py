"""Column-expression helpers: text primitives, regex dialect, number formatting."""
