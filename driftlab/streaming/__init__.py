"""driftlab streaming."""
