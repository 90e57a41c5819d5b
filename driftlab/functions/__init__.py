"""driftlab functions."""
