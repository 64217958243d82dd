"""sources of riskweave."""
