"""Named query plans."""
