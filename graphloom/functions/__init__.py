"""Part of graphloom; see README.md."""
