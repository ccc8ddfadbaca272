"""evalflow operators."""
