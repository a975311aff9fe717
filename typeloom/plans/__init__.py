"""The type graph: nodes, folding, simplification, and declarations."""
