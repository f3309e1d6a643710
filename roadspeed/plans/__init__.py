"""Composed plans: stand-in inputs, numbering, registered queries."""
