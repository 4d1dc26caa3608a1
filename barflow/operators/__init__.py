"""operators of the market-bar library."""
