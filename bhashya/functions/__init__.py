"""Part of bhashya; see README.md."""
