"""Where the search of a pattern begins: plans, cost functions, and the presets that combine them."""
