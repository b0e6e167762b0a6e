"""Part of candor; see the README."""
