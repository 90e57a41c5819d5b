"""driftlab operators."""
