"""Driver-side analyses and shared helpers."""
