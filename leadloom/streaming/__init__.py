"""The event log and the evidence feed as streams."""
