"""Functions of the evidence and reachability engine."""
