"""Part of astrolith: operators."""
