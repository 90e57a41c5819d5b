"""driftlab sources."""
