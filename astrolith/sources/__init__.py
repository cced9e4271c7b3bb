"""Part of astrolith: sources."""
