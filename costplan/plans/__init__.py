"""Query shapes, join orders and plan texts."""
