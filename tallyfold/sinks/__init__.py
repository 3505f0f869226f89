"""Exports, manifests, ledgers and refreshes."""
