"""functions of the market-bar library."""
