"""plans of the market-bar library."""
