"""evalflow functions."""
