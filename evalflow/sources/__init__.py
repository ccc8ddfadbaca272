"""evalflow sources."""
