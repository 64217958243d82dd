"""functions of riskweave."""
