"""Column expressions and the few aggregated-row UDFs."""
