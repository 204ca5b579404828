"""Part of the text-safety engine."""
