"""driftlab plans."""
