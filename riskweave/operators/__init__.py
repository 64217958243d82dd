"""operators of riskweave."""
