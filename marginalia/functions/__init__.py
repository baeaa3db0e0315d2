"""Part of marginalia."""
