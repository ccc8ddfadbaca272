"""evalflow plans."""
