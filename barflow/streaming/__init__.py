"""streaming of the market-bar library."""
