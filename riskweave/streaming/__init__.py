"""streaming of riskweave."""
