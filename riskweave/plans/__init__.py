"""plans of riskweave."""
