"""evalflow streaming."""
