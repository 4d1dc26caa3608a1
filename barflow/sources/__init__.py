"""sources of the market-bar library."""
