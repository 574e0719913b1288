"""Stop detection."""
