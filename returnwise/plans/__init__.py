"""End-to-end stages over a store."""
